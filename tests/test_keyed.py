"""The scaler on keyed state: restarts, timers and what the state store tells."""

import time

import pytest
from pyspark.sql import functions as F

from paceline.functions.sizes import CoreLimits, JobSize
from paceline.plans.policies import Settings
from paceline.schemas import MESSAGES
from paceline.streaming.keyed import KeyedScaler, kept_attempts
from paceline.streaming.scaler import Scaler, StateTables
from tests import model
from tests.test_fold import frame, messages
from tests.test_policies import POLICIES


def settings(**more):
    return Settings(
        policies=POLICIES, limits=CoreLimits(8, 14), default_size=JobSize(1024, 5, 2), chunk=50,
        **{"max_staleness_ms": 10**9, **more},
    )


def queue(scaler, spark):
    rows = scaler.tables.read(spark, "actions", scaler.last_step).collect()
    return sorted((r.seq, r.job_id, r.attempt_id, r.type, r.status, r.target_size) for r in rows)


@pytest.mark.parametrize("seed,off,max_attempts", [(36, 0.0, 100), (24, 0.1, 3)])
def test_five_batches_and_a_restart(spark, tmp_path, seed, off, max_attempts):
    """The same queue as the tables give after each batch, and the attempts of a sequential reading."""
    rows = messages(seed, 1500, jobs=5, attempts=6 if max_attempts < 10 else 2, off=off)
    cuts = [0, 300, 301, 700, 1100, 1500]
    own = settings(max_attempts=max_attempts)
    now = max(r["ts"] for r in rows)
    tables = Scaler(StateTables(str(tmp_path / "tables")), own, now_ms=now)
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    scalers = []
    for step, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = frame(spark, rows[a:b])
        tables.step(batch, step)
        batch.coalesce(1).write.mode("append").parquet(source)
        if step != 1:  # the first run has a batch, the second two of them; each is a new query
            scalers.append(KeyedScaler(StateTables(str(tmp_path / "state")), own, now_ms=now))
            stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(source)
            scalers[-1].start(stream, log, trigger={"availableNow": True}).awaitTermination()
    assert scalers[-1].last_step == 4 and sum(s.heard for s in scalers) == 5
    assert queue(scalers[-1], spark) == queue(tables, spark)
    _, jobs = model.read(rows, max_attempts=max_attempts, length_ms=300_000)
    kept = kept_attempts(spark, log)
    assert {(r.job_id, r.attempt_id, r.created, r.first_time, r.last_time) for r in kept.collect()} == {
        (j, a, s.created, s.first, s.last) for j, known in jobs.items() for a, s in known.items()
    }
    early = kept_attempts(spark, log, 0).agg(F.max("last_arr")).first()[0]
    assert early <= rows[299]["arr"] < kept.agg(F.max("last_arr")).first()[0]


def test_timers_evaluate_and_retry_without_input(spark, tmp_path):
    rows = [{**r, "load": r["load"] and 3 * r["load"]} for r in messages(36, 2000, jobs=8, attempts=2)]
    source, free = str(tmp_path / "in"), [0]
    frame(spark, rows).coalesce(1).write.parquet(source)
    wanted = Scaler(StateTables(str(tmp_path / "tables")), settings(), now_ms=rows[-1]["ts"])
    wanted.step(frame(spark, rows), 0)

    def capacity():
        jobs = [(j, free[0], 10**6) for j in {r["job_id"] for r in rows}]
        return spark.createDataFrame(jobs, "job_id string, free_cores int, free_mb int")

    scaler = KeyedScaler(
        StateTables(str(tmp_path / "state")), settings(), now_ms=rows[-1]["ts"], capacity=capacity, interval_ms=1500
    )
    stream = spark.readStream.schema(MESSAGES).parquet(source)
    query = scaler.start(stream, str(tmp_path / "log"), trigger={"processingTime": "1 second"})
    try:
        end, seen = time.time() + 120, set()
        while time.time() < end and query.isActive:
            time.sleep(0.5)
            if scaler.last_step < 0:
                continue
            states = {x[4] for x in queue(scaler, spark)}
            seen |= states
            if "ENQUEUED" in states:
                free[0] = 100
            if states == {"ISSUED"}:
                break
    finally:
        query.stop()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [2000]
    assert [(j, a, t, s) for _, j, a, t, _, s in queue(scaler, spark)] == [
        (j, a, t, s) for _, j, a, t, _, s in queue(wanted, spark)
    ]
    assert "ENQUEUED" in seen
