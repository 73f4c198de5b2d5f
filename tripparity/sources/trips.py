"""Trip sources: the ``trips`` view over ``events`` and the raw-trip scan.

The raw-trip contract uses the public yellow-taxi column names. ``trips`` is our fixture: it maps
the generic ``events`` table onto trips so every job reads data whose size grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Raw trip columns in their declared order.
RAW_COLUMNS = (
    "tpep_pickup_datetime",
    "passenger_count",
    "trip_distance",
    "PULocationID",
    "DOLocationID",
    "fare_amount",
)

TRIP_KEY = "trip_id"


def read_table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """A table of the fixture folder, as the scan splits it; ``partitions`` spreads it over that many tasks."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(partitions) if partitions else df


def trips_from_events(events: DataFrame) -> DataFrame:
    """The ``trips`` view (see FIXTURES.md section 2): one trip per event, ``event_id`` is the key.

    pickup_datetime stays TIMESTAMP_NTZ; training reads it as New York wall clock, serving as UTC.
    """
    # json_tuple parses each props string once (a generator, so no later filter re-parses it).
    events = events.select("event_id", "ts", "user_id", "event_type", "value",
                           F.json_tuple("props", "k").alias("_k"))
    k = F.col("_k").try_cast("int")
    distance = F.col("value").cast("double") / F.lit(4.0)
    fare = F.when((F.col("event_type") == "error") & (k < 10), F.lit(-5.0)).otherwise(
        F.lit(3.0) + F.lit(2.5) * distance + (F.col("event_id") % 7).cast("double"))
    return events.select(
        F.col("event_id").alias("trip_id"),
        F.col("ts").alias("pickup_datetime"),
        F.col("user_id").cast("bigint").alias("pickup_location_id"),
        ((F.col("event_id") * 7919) % 263).alias("dropoff_location_id"),
        F.when(k % 10 == 9, F.lit(None).cast("double")).otherwise((k % 10).cast("double"))
        .alias("passenger_count"),
        distance.alias("trip_distance"),
        fare.alias("fare_amount"),
        F.col("event_type"),
    )


def load_trips(spark: SparkSession, sf_dir: str, distance: tuple[float, float] | None = None) -> DataFrame:
    """The trips view; ``distance`` (inclusive miles) is also asked of ``value`` itself, four times the
    miles and exactly so in binary, which lets the scan skip row groups."""
    events = read_table(spark, sf_dir, "events")
    if distance:
        events = events.where(F.col("value").between(4 * distance[0], 4 * distance[1]))
    return trips_from_events(events)


def raw_trips_from_trips(trips: DataFrame, keep_key: bool = True) -> DataFrame:
    """The trips view under the raw-trip contract's column names (all numerics as double)."""
    key = [F.col(TRIP_KEY)] if keep_key else []
    return trips.select(
        *key,
        F.col("pickup_datetime").alias("tpep_pickup_datetime"),
        F.col("passenger_count").cast("double").alias("passenger_count"),
        F.col("trip_distance").cast("double").alias("trip_distance"),
        F.col("pickup_location_id").cast("double").alias("PULocationID"),
        F.col("dropoff_location_id").cast("double").alias("DOLocationID"),
        F.col("fare_amount").cast("double").alias("fare_amount"),
    )


def first_rows(table: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a Parquet table in file order (files by path, rows as they are written).

    Rows per file come from the footers; with them one (path, rows) pair says where the ``n`` rows end,
    so the files after it are not read and the last one only contributes the rows before the end. The
    same rows come out on every run and every cluster; fewer than ``n`` rows are all taken.
    """
    if n < 1:
        raise ValueError("the first N rows need N of at least 1")
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = table.groupBy(path.alias("file")).agg(F.count(F.lit(1)).alias("n"))
    upto = files.withColumn("upto", F.sum("n").over(Window.orderBy("file")))  # one row per file
    end = upto.where(F.col("upto") >= n).orderBy("file").select("file", (F.lit(n) - F.col("upto") + F.col("n")).alias("wanted")).first()
    if end is None:
        return table
    return table.where((path <= end["file"]) & ((path < end["file"]) | (index < end["wanted"])))


def load_raw_trips(spark: SparkSession, path: str, row_limit: int | None = None,
                   order_by: tuple[str, ...] = ()) -> DataFrame:
    """Scan only the six raw columns; optional first-N rows, in file order or by ``order_by``.

    A missing dataset raises ``FileNotFoundError``; ``row_limit < 1`` raises ``ValueError``.
    """
    if row_limit is not None and row_limit < 1:
        raise ValueError("the first N rows need N of at least 1")
    try:
        raw = spark.read.parquet(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"no trips at {path}") from exc
    if row_limit is not None and not order_by:
        raw = first_rows(raw, row_limit)
    raw = raw.select(*order_by, *[c for c in RAW_COLUMNS if c not in order_by])
    if row_limit is not None and order_by:
        raw = raw.orderBy(*order_by).limit(row_limit)
    return raw
