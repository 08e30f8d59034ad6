"""The action queue."""

import pytest
from pyspark.sql import functions as F

from paceline.operators.actions import (
    enqueue, next_to_issue, trim, with_capacity, without_action,
)
from paceline.operators.arrival import newest_per_key
from paceline.plans.cycle import issue_round, queue_round
from paceline.plans.policies import Settings
from paceline.schemas import CAPACITY, SIZING_ACTIONS
from paceline.sources.writers import record_issued

SMALL, BIG = (1024, 4, 1), (1024, 8, 1)


def actions(spark, *rows):
    return spark.createDataFrame(list(rows), SIZING_ACTIONS)


def action(seq, job="j", attempt="a1", status="ENQUEUED", current=SMALL, target=BIG):
    return (seq, job, attempt, current, target, status, "JOB_VCORE_SCALEUP")


def statuses(df):
    return {r.seq: r.status for r in df.collect()}


def test_an_action_blocks_its_attempt_only(spark):
    held = actions(spark, action(1), action(2, "k", "a1", "ISSUED"))
    attempts = spark.createDataFrame(
        [("j", "a1"), ("j", "a2"), ("k", "a1")], "job_id string, attempt_id string"
    )
    left = without_action(attempts, held).collect()
    assert [(r.job_id, r.attempt_id) for r in left] == [("j", "a2")]
    waiting_only = without_action(attempts, held, ("ENQUEUED",)).collect()
    assert {(r.job_id, r.attempt_id) for r in waiting_only} == {("j", "a2"), ("k", "a1")}


def test_no_capacity_leaves_the_head_enqueued(spark):
    queue = actions(spark, action(1), action(2), action(1, "k"))
    full = spark.createDataFrame([("j", 3, 0)], CAPACITY)
    after, issued = issue_round(queue.filter("job_id = 'j'"), full)
    assert statuses(after) == {1: "ENQUEUED", 2: "ENQUEUED"} and issued.isEmpty()
    enough = spark.createDataFrame([("j", 4, 0)], CAPACITY)
    after, issued = issue_round(queue, enough)
    assert {(r.job_id, r.seq) for r in issued.collect()} == {("j", 1), ("k", 1)}
    assert statuses(after.filter("job_id = 'j'")) == {1: "ISSUED", 2: "ENQUEUED"}
    again, issued = issue_round(after, None)
    assert [(r.job_id, r.seq) for r in issued.collect()] == [("j", 2)]


def test_unknown_current_size_is_accepted(spark):
    queue = actions(spark, action(1, current=None))
    assert with_capacity(queue, None).count() == 1
    assert with_capacity(queue, spark.createDataFrame([("j", 8, 1024)], CAPACITY)).count() == 1
    assert with_capacity(queue, spark.createDataFrame([("j", 7, 1024)], CAPACITY)).count() == 0


def test_failed_enforcement_is_tried_again(spark, tmp_path):
    queue = actions(spark, action(1))

    def fail(issued):
        raise RuntimeError("busy")

    after, issued = issue_round(queue, enforce=fail)
    assert statuses(after) == {1: "ENQUEUED"} and issued.isEmpty()
    log = str(tmp_path / "issued")
    after, _ = issue_round(after, enforce=record_issued(log, 3))
    assert statuses(after) == {1: "ISSUED"} and spark.read.parquet(log).count() == 1
    issue_round(queue, enforce=record_issued(log, 3))  # the step runs again
    assert spark.read.parquet(log).count() == 1


def test_the_oldest_action_is_dropped(spark):
    rows = spark.range(2001).select(
        F.col("id").alias("seq"), F.lit("j").alias("job_id"), F.lit("a").alias("attempt_id"),
        F.lit(None).cast(SIZING_ACTIONS["current_size"].dataType).alias("current_size"),
        F.lit(None).cast(SIZING_ACTIONS["target_size"].dataType).alias("target_size"),
        F.lit("ENQUEUED").alias("status"), F.lit("JOB_VCORE_SCALEUP").alias("type"),
    )
    kept = trim(rows)
    assert kept.count() == 2000 and kept.agg(F.min("seq")).first()[0] == 1
    assert next_to_issue(kept).first().seq == 1


@pytest.mark.parametrize("keep", [3, 1001])
def test_newest_per_key_with_and_without_salt(spark, keep):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("n"))
    kept = newest_per_key(rows, ["k"], "n", keep)
    assert kept.groupBy("k").count().collect()[0]["count"] == keep
    assert kept.agg(F.min("n")).first()[0] == 3000 - 2 * keep


def test_round_appends_and_trims(spark):
    queue = actions(spark, action(1), action(2))
    proposals = actions(spark, action(0, attempt="a9"))
    after = queue_round(queue, proposals, 3, Settings(max_actions=2))
    assert statuses(after) == {2: "ENQUEUED", 3: "ENQUEUED"}
    assert enqueue(queue, proposals, 7).filter("seq = 7").first().attempt_id == "a9"
