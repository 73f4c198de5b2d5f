"""Session construction and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job in this package assumes. None of the operators depend on the session time
# zone (all wall-clock arithmetic is done on TIMESTAMP_NTZ with explicit zones), but UTC keeps
# printed instants readable.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Local mode runs executors inside the driver JVM; only applies when this call starts the JVM.
    "spark.driver.memory": "8g",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tripparity", extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set to a folder that all executors share. Only in local mode, where the
    driver is the executor, an unset folder is replaced by a temporary one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tripparity-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root}/tripparity/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's file system, so it also works on shared storage."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system; a missing one is fine."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable by Python workers (``mapInPandas`` kernels, broadcasts).

    Zips the package in memory, writes it into the shared checkpoint folder through Hadoop's file
    system API (so it works for any scheme) and registers it with ``addPyFile`` once per
    SparkContext; on a cluster submitted with ``--py-files`` this is a harmless repeat.
    """
    import io
    import os
    import zipfile

    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    package_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package_dir)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(package_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    target = scratch_path(spark, "pyfiles") + "/tripparity.zip"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(target)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(hadoop_path, True)
    try:
        out.write(bytearray(buffer.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(key)


__all__ = ["build_session", "checkpoint_root", "ensure_checkpoint_dir", "scratch_path", "path_exists", "delete_path", "ship_package"]
