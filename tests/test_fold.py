"""The ordered fold against the sequential model, with tiny chunks so that every
carry-over between chunks is exercised."""

import random

import pytest
from pyspark.sql import functions as F

from paceline.operators.arrival import gate, running_count
from paceline.operators.fold import LIFE, fold, with_lives
from paceline.operators.state import job_state, latest_attempts
from paceline.schemas import MESSAGES
from tests import model

T0 = 1_700_000_000_000


def messages(seed, n, *, jobs=3, attempts=4, off=0.0, spread=5, gaps=False):
    rng = random.Random(seed)
    rows, arr = [], 0
    for i in range(n):
        arr += rng.randint(1, 40) if gaps else 1
        rows.append(
            {
                "arr": arr,
                "job_id": f"j{rng.randrange(jobs)}",
                "attempt_id": f"a{rng.randrange(attempts)}" if rng.random() > 0.02 else "",
                "container": f"c{rng.randrange(3)}",
                "enabled": rng.random() >= off,
                "ts": T0 + (i + rng.randint(-spread, spread)) * 7_000,
                "is_worker": rng.random() < 0.8,
                "load": round(rng.random() * 10, 2),
            }
        )
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in MESSAGES.names) for r in rows], MESSAGES)


def check(spark, rows, *, max_attempts=100, chunk=1 << 20):
    counted, jobs = model.read(rows, max_attempts=max_attempts)
    df = frame(spark, rows).repartition(5)
    lives = with_lives(df, max_attempts=max_attempts, chunk=chunk).cache()
    kept = gate(lives, LIFE, chunk=chunk).cache()
    assert sorted(r.arr for r in kept.select("arr").collect()) == counted
    expected = {
        (j, a, s.created, s.first, s.last) for j, known in jobs.items() for a, s in known.items()
    }
    for source in (lives, kept):
        state = job_state(source).cache()
        found = {
            (r.job_id, r.attempt_id, r.created, r.first_time, r.last_time)
            for r in state.collect()
        }
        assert found == expected
    newest = {(j, next(reversed(known))) for j, known in jobs.items()}
    assert {(r.job_id, r.attempt_id) for r in latest_attempts(state).collect()} == newest


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_all_enabled(spark, chunk):
    check(spark, messages(1, 600), chunk=chunk)


@pytest.mark.parametrize("seed,off,chunk", [(2, 0.05, 11), (3, 0.3, 5), (4, 0.6, 50), (5, 0.9, 13)])
def test_resets(spark, seed, off, chunk):
    check(spark, messages(seed, 500, attempts=6, off=off, gaps=seed % 2 == 0), chunk=chunk)


def test_resets_in_one_chunk(spark):
    check(spark, messages(6, 400, off=0.4))


@pytest.mark.parametrize("seed,off", [(7, 0.0), (8, 0.2)])
def test_attempts_that_come_back_after_being_pushed_out(spark, monkeypatch, seed, off):
    monkeypatch.setattr("paceline.operators.replay.WIDTH", 70)
    check(spark, messages(seed, 500, jobs=2, attempts=7, off=off), max_attempts=3, chunk=17)


@pytest.mark.parametrize("off", [0.0, 0.1])
def test_attempts_pushed_out_for_good(spark, off):
    """Attempts follow each other, so nothing comes back."""
    rows = messages(9, 600, jobs=3, attempts=1, off=off)
    for i, row in enumerate(rows):
        row["attempt_id"] = f"a{i // 50:03d}"
    check(spark, rows, max_attempts=4, chunk=23)


def test_one_job_holds_almost_everything(spark):
    rows = messages(10, 500, jobs=1, attempts=2, off=0.1) + [
        dict(m, arr=m["arr"] + 10_000, job_id=f"small{i}")
        for i, m in enumerate(messages(11, 20, jobs=1))
    ]
    check(spark, rows, chunk=9)


def test_reset_vectors(spark):
    def rows(*items):
        return frame(
            spark,
            [
                dict(arr=i, job_id="j", attempt_id=a, container="c", enabled=e, ts=T0 + ts,
                     is_worker=True, load=1.0)
                for i, (a, e, ts) in enumerate(items)
            ],
        )

    one = job_state(with_lives(rows(("a1", True, 5)))).collect()
    assert [(r.first_time - T0, r.last_time - T0) for r in one] == [(5, 5)]

    late = rows(("a1", True, 0), ("a2", True, 2), ("a1", True, 1))
    assert latest_attempts(job_state(with_lives(late))).first().attempt_id == "a2"

    off = rows(("a1", True, 0), ("a2", False, 1))
    assert job_state(with_lives(off)).isEmpty()

    same = fold(rows(("a1", True, 10), ("a1", True, 5), ("a1", True, 10)))
    assert sorted(r.arr for r in same.collect()) == [0, 2]

    many = rows(*[(f"a{i}", True, i) for i in range(101)])
    state = job_state(with_lives(many))
    assert state.count() == 100 and state.filter("attempt_id = 'a0'").isEmpty()


def test_gate_and_running_count_with_tiny_chunks(spark):
    df = frame(spark, messages(12, 300, jobs=2, attempts=2))
    for chunk in (3, 1 << 20):
        kept = gate(df.filter("attempt_id <> ''"), ["job_id", "attempt_id"], chunk=chunk)
        assert sorted(r.arr for r in kept.collect()) == model.read(messages(12, 300, jobs=2, attempts=2))[0]
        counted = running_count(df, ["job_id"], chunk=chunk)
        last = {r.job_id: r.n for r in counted.groupBy("job_id").agg(F.max("n").alias("n")).collect()}
        assert last == {r.job_id: r.n for r in df.groupBy("job_id").agg(F.count("*").alias("n")).collect()}
        assert counted.select("job_id", "n").distinct().count() == 300


def test_a_hot_job_is_replayed_in_many_tasks(spark, monkeypatch):
    """No reset is certain; chunks are rows of their own, and few of them are replayed more than once."""
    from paceline.operators import replay

    again = []

    def counted(chunks, keep):
        again.append(chunks.count())
        return replays(chunks, keep)

    replays = replay._replays
    monkeypatch.setattr(replay, "_replays", counted)
    rng = random.Random(13)
    rows = [
        dict(m, attempt_id=f"a{min(i // 40 + rng.choice([0, 0, 0, 1, -6]), 60)}") for i, m in enumerate(messages(13, 2000, jobs=1))
    ]
    found = replay.replayed(frame(spark, rows), 4, 100).cache()
    assert found.count() == again[0] == 21 and sum(again[1:]) < 42
    queue = []
    changes = []
    for m in rows:
        if m["attempt_id"] not in queue:
            changes.append(m["arr"])
            queue = [*queue, m["attempt_id"]][-4:]
    assert [c.arr for r in found.orderBy("chunk").collect() for c in r.changes] == changes
    assert found.orderBy(F.desc("chunk")).first().queue == queue
    assert "Python" not in _physical(found)


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()
