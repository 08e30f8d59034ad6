"""Golden vectors of the scaling rules, and whole evaluations against the model."""

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from paceline.functions.sizes import CoreLimits, JobSize, resize_cores, size_struct, within_limit
from paceline.functions.times import MINUTE_MS
from paceline.operators.buckets import bucket
from paceline.operators.fold import LIFE, NO_RESET
from paceline.plans.evaluate import decide, evaluate
from paceline.plans.policies import Settings, cpu_scale_down, cpu_scale_up, settings_from_properties
from paceline.schemas import JOB_SIZE, MESSAGES
from tests import model
from tests.test_fold import frame, messages

T0 = 1_700_000_040_000  # a whole minute
HALF_HOUR = 30 * MINUTE_MS


def settings(*policies, **options):
    return Settings(
        policies=policies, limits=CoreLimits(per_container=50, per_job=2048), **options
    )


UP = cpu_scale_up(window_ms=HALF_HOUR, trigger=2.0, margin=0.1, allow=".*test.*")
DOWN = cpu_scale_down(window_ms=HALF_HOUR, trigger=0.2, margin=0.1, allow=".*test.*")


def proposals(spark, policy, cases, minutes=range(31)):
    """cases: {job: (cores, usage)} → {job: (type, target cores)}."""
    schema = "job_id string, attempt_id string, life bigint, first_time bigint, cores int"
    latest = spark.createDataFrame(
        [(j, "a", NO_RESET, T0, cores) for j, (cores, _) in cases.items()], schema
    ).withColumn("size", size_struct(F.lit(100), F.col("cores"), F.lit(3)))
    points = spark.createDataFrame(
        [
            (j, "a", NO_RESET, T0 + (10 + m) * MINUTE_MS, float(usage))
            for j, (_, usage) in cases.items()
            if usage is not None
            for m in minutes
        ],
        "job_id string, attempt_id string, life bigint, bucket bigint, v double",
    )
    found = decide(latest, points, settings(policy)).collect()
    assert all((r.target_size.container_mb, r.target_size.container_count) == (100, 3) for r in found)
    return {r.job_id: (r.type, r.target_size.container_num_cores) for r in found}


def test_scale_up_vectors(spark):
    found = proposals(
        spark,
        UP,
        {
            "test-below": (10, 19.9),
            "test-above": (10, 20.1),
            "test-capped": (10, 51.0),
            "prod-job": (10, 30.0),
            "test-no-window": (10, None),
            "test-nan": (10, math.nan),
        },
    )
    assert found == {
        "test-above": ("JOB_VCORE_SCALEUP", 23),
        "test-capped": ("JOB_VCORE_SCALEUP", 50),
    }


def test_scale_down_vectors(spark):
    found = proposals(
        spark,
        DOWN,
        {
            "test-low": (30, 5.9),
            "test-high": (30, 6.1),
            "test-zero": (100, 0.0),
            "test-negative": (100, -1.0),
            "test-no-window": (10, None),
            "test-nan": (10, math.nan),
        },
    )
    assert found == {
        "test-low": ("JOB_VCORE_SCALEDOWN", 6),
        "test-zero": ("JOB_VCORE_SCALEDOWN", 1),
        "test-negative": ("JOB_VCORE_SCALEDOWN", 1),
    }


@pytest.mark.parametrize(
    "minutes,valid",
    [(range(31), True), ([0, 30], True), (range(1, 31), False), (range(30), False), ([30], False)],
)
def test_a_window_needs_its_first_minute(spark, minutes, valid):
    """The 40th minute after the start must be there, or the window is not full."""
    found = proposals(spark, UP, {"test": (10, 30.0)}, minutes=minutes)
    full = proposals(spark, UP, {"test": (10, 30.0)}, minutes=[*minutes, -100])
    assert bool(found) is valid
    assert bool(full) is valid


def test_start_phase_blocks_a_window(spark):
    assert proposals(spark, UP, {"test": (10, 30.0)}, minutes=range(-10, 21)) == {}
    assert proposals(spark, UP, {"test": (10, 30.0)}, minutes=range(-9, 22)) != {}


def test_resize_vectors(spark):
    limits = CoreLimits(per_container=50, per_job=2048)
    rows = spark.createDataFrame(
        [(60, 3, 200), (10, 3, 57), (10, 100, 40), (5, 3, 0), (5, 0, 9)], "cores int, n int, target int"
    )
    size = size_struct(F.lit(100), F.col("cores"), F.col("n"))
    found = [r.to for r in rows.select(resize_cores(size, F.col("target"), limits).alias("to")).collect()]
    assert [r and r.container_num_cores for r in found] == [60, 50, 20, 1, None]


def test_within_limit(spark):
    rows = spark.createDataFrame(
        [(9.0, 10.0), (5.0, 10.0), (98.0, 100.0), (0.0, 0.0), (5.0, 0.0), (-9.0, 0.0)], "a double, b double"
    )
    found = rows.select(within_limit(F.col("a"), F.col("b"), 0.1, 0).alias("x")).collect()
    assert [r.x for r in found] == [True, False, True, True, True, False]


def test_properties(spark):
    values = {
        "asc.policy.max-staleness.ms": "200000",
        "asc.policy.stateless.maxcontainermb": "12288",
        "asc.policy.stateless.maxjobmemorymb": "1019200",
        "asc.policy.stateless.maxnumvcorespercontainer": "15",
        "asc.policy.stateless.maxnumvcoresperjob": "7500",
        "asc.policy.cpuscaleup.whitelist": ".*-test-job",
        "asc.policy.cpuscaleup.window.ms": "3600000",
        "asc.policy.cpuscaleup.trigger.factor": "1.1",
        "asc.policy.cpuscaleup.margin.fraction": "0.0",
        "asc.policy.cpuscaledown.window.ms": "86400000",
        "asc.policy.cpuscaledown.trigger.factor": "0.5",
        "asc.policy.cpuscaledown.margin.fraction": "0.0",
    }
    made = settings_from_properties(values)
    assert made.policies[0].allow == ".*-test-job" and made.policies[1].allow == ".*"
    assert made.policies[0].window_ms == 3_600_000 and made.retention_ms == 86_400_000
    assert made.deny == "" and made.limits.per_job == 7500


POLICIES = (
    cpu_scale_up(window_ms=150_000, trigger=1.1, margin=0.2),
    cpu_scale_down(window_ms=300_000, trigger=0.9, margin=0.1),
)
MODEL_POLICIES = [
    ("JOB_VCORE_SCALEUP", 150_000, True, 1.1, 0.2),
    ("JOB_VCORE_SCALEDOWN", 300_000, False, 0.9, 0.1),
]


@pytest.mark.parametrize("seed,off,chunk", [(36, 0.0, 13), (37, 0.01, 1 << 20)])
def test_evaluate_equals_the_model(spark, seed, off, chunk):
    rows = messages(seed, 4000, jobs=8, attempts=2, off=off)
    for row in rows:
        if int(row["job_id"][1:]) % 2:
            row["load"] = round(row["load"] * 0.4, 2)
    _, jobs = model.read(rows, length_ms=300_000)
    now = max(s.last for known in jobs.values() for s in known.values())
    limits, size = CoreLimits(per_container=8, per_job=14), (1024, 5, 2)
    made = Settings(
        policies=POLICIES, limits=limits, default_size=JobSize(*size), deny="j3|j4",
        max_staleness_ms=400_000, chunk=chunk,
    )
    expected = {}
    for job, known in jobs.items():
        name = next(reversed(known))
        if job in ("j3", "j4") or now - known[name].last > 400_000:
            continue
        action = model.decide(known[name], size, MODEL_POLICIES, limits)
        if action:
            expected[job] = (name, *action)
    found = evaluate(frame(spark, rows), made, now).collect()
    assert {r.job_id: (r.attempt_id, r.type, tuple(r.target_size)) for r in found} == expected
    assert len({kind for _, kind, _ in expected.values()}) == 2


def test_a_window_far_before_the_last_message_is_found(spark):
    """Long after its last metric a deployment still sends other messages."""
    rows, arr = [], 0
    for job, quiet_minutes in (("near", 0), ("far", 90), ("none", 90)):
        for minute in range(40 + quiet_minutes):
            arr += 1
            rows.append(
                dict(arr=arr, job_id=job, attempt_id="a", container="c", enabled=True,
                     ts=T0 + minute * MINUTE_MS, load=9.0,
                     is_worker=minute < 40 and job != "none")
            )
    made = Settings(policies=POLICIES, limits=CoreLimits(50, 500), default_size=JobSize(1, 5, 1))
    now = T0 + 130 * MINUTE_MS
    made = replace(made, max_staleness_ms=10**9)
    found = evaluate(frame(spark, rows), made, now).collect()
    assert {r.job_id for r in found} == {"near", "far"}
    assert evaluate(frame(spark, rows).filter("job_id = 'none'"), made, now).isEmpty()


def test_bucket_vectors(spark):
    rows = frame(
        spark,
        [
            dict(arr=i, job_id="j", attempt_id="a", container=f"c{i}", enabled=True, ts=T0 + i,
                 is_worker=w, load=v)
            for i, (v, w) in enumerate([(3.0, True), (7.0, True), (99.0, False)])
        ],
    )
    assert [(r.bucket, r.v) for r in bucket(rows).collect()] == [(T0, 7.0)]
    assert [r.v for r in bucket(rows, fold="sum").collect()] == [10.0]


def test_size_schema(spark):
    made = spark.range(1).select(size_struct(F.lit(1), F.lit(2), F.lit(3)).alias("s"))
    assert [f.dataType for f in made.schema["s"].dataType] == [f.dataType for f in JOB_SIZE]
    assert MESSAGES.names[0] == "arr" and LIFE[-1] == "life"
    assert replace(Settings(), max_actions=5).max_actions == 5
