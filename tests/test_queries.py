"""Every named query against its SQL counterpart, and the plans of the heavy ones."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from paceline.plans import views
from paceline.plans.catalog import QUERIES
from paceline.plans.sql_counterparts import SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, pd.Timestamp):
        return str(v)
    return repr(float(v)) if isinstance(v, float) else str(v)


def _rows(df):
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def test_all_queries_have_sql():
    """The training-data operators, if installed, have their own tests."""
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, database, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    theirs = database.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


def test_entry(spark):
    assert entry_points.entry(spark).columns == QUERIES["scale_up"](spark, FOLDER).columns


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["evaluate_policies", "accepted_messages", "click_count_15s", "action_round"])
def test_plans_have_no_cross_join_and_read_few_columns(spark, name):
    _, physical = _plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    assert "props" not in physical
    assert "Python" not in physical


def test_messages_are_shuffled_once_for_the_gate(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        _, physical = _plan(QUERIES["accepted_messages"](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # No key is large here, so nothing but the rows is exchanged.
    assert physical.count("Exchange hashpartitioning") == 1
    assert views.events(spark, FOLDER).count() == 1000


def test_evaluation_reads_only_recent_messages(spark, tmp_path, monkeypatch):
    """The lowest time bound of the candidates is pushed down to the message files."""
    from paceline.plans import evaluate as evaluation

    path = str(tmp_path / "messages")
    views.messages(views.events(spark, FOLDER)).write.parquet(path)
    plans = []

    def spy(rows):
        plans.append(_plan(rows)[1])
        return saved(rows)

    saved = evaluation.saved
    monkeypatch.setattr(evaluation, "saved", spy)
    messages = spark.read.parquet(path)
    evaluation.evaluate(messages, views.SETTINGS, views.latest_time).collect()
    tail = next(p for p in plans if "Window" in p)
    assert "GreaterThanOrEqual(ts," in tail
    assert "BroadcastHashJoin" in tail  # the candidates are few, by their measured size
    assert "container" not in tail and "enabled" not in tail
