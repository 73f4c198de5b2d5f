"""The driver contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_module
from tripparity.plans.catalog import base_queries

ROWS_ONLY = {"model_comparison", "model_selected", "runs_table", "model_info", "score_tree", "explain_tree",
             "importance_tree"}


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert {"feature_mode", "applied_skew_mode", "matched_count", "trips"} <= set(df.columns)


def test_every_query_has_an_oracle_unless_rows_only():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    own = set(base_queries())
    assert own <= set(queries) and own - set(sql) == ROWS_ONLY


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without the llm folders and the pipeline imports and registers all other queries."""
    root = Path(entry_module.__file__).parent
    for part in ("tripparity", "__spark_entry__.py"):
        source, target = root / part, tmp_path / part
        if source.is_dir():
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, target)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    names, sql = (line.split() for line in done.stdout.strip().splitlines()[-2:])
    assert set(names) == set(base_queries()) and set(sql) == set(base_queries()) - ROWS_ONLY
