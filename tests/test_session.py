import os
import subprocess
import sys
from pathlib import Path

import pytest

from paceline.plans import views
from paceline.plans.catalog import QUERIES
from paceline.session import saved, scratch, session_dir, shared_dir

ROOT = Path(__file__).resolve().parent.parent
FOLDER = "/root/testdata/sf0.001"


def folders(spark) -> set[str]:
    path = session_dir(spark).removeprefix("file:")
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_a_run_leaves_nothing_behind(spark):
    before = folders(spark)
    with scratch(spark) as folder:
        rows = saved(spark.range(5))
        assert QUERIES["evaluate_policies"](spark, FOLDER).count() and rows.count() == 5
        assert os.listdir(folder)
    assert folders(spark) == before


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_reset_queries_run_from_anywhere(spark, tmp_path):
    """Workers find no copy of the package, and the plan has no Python."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("state_with_resets", "fold_with_evictions"):
    rows = entry.queries()[name](spark, {FOLDER!r})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
    assert rows.count()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_the_entry_works_without_the_training_data_operators(tmp_path):
    """A copy of the repository without them still imports and lists the other queries."""
    (tmp_path / "paceline").mkdir()
    for part in (ROOT / "paceline").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "paceline" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(QUERIES))] * 2, done.stderr[-2000:]


def test_a_large_key_is_the_only_one_cut(spark):
    """Rows of plain keys are neither aggregated nor joined beside their one exchange."""
    from paceline.operators.arrival import running_count

    rows = views.crowded_messages(views.events(spark, FOLDER))
    found = {(r.arr, r.job_id): r.n for r in running_count(rows, ["job_id"], chunk=100).collect()}
    places: dict[str, int] = {}
    for r in sorted(rows.collect(), key=lambda r: r.arr):
        places[r.job_id] = places.get(r.job_id, 0) + 1
        assert found[r.arr, r.job_id] == places[r.job_id]
