"""Configuration in force at first sight, running values over chunks, and rolling windows over chunks of time."""

import random

from pyspark.sql import functions as F

from paceline.functions.sizes import JobSize
from paceline.operators.arrival import running
from paceline.operators.buckets import rolling
from paceline.operators.state import with_size_as_of

STATE = "job_id string, attempt_id string, created long, first_time long"
HISTORY = (
    "job_id string, valid_from long, seq long, container_mb int, container_num_cores int, container_count int"
)


def test_the_size_in_force_at_first_sight(spark):
    """A hot job with many chunks, ties, times before and after everything, and nulls."""
    rng = random.Random(2)
    history = [("hot", rng.randrange(400), k, k, k % 9, 1) for k in range(300)]
    history += [("a", 100, 1, 1, 1, 1), ("a", 100, 2, 2, 2, 2), ("a", 100, None, 9, 9, 9), ("a", 200, 3, None, 3, 3)]
    history += [("b", None, 1, 7, 7, 7), (None, 5, 5, 5, 5, 5)]
    seen = [("hot", f"h{k}", k, rng.randrange(-10, 420)) for k in range(300)]
    seen += [("a", "x", 1, 99), ("a", "y", 2, 100), ("a", "z", 3, 199), ("a", "w", 4, 200), ("b", "x", 1, 0), ("c", "x", 1, 5)]
    default = JobSize(11, 12, 13)
    frames = [spark.createDataFrame(r, s).repartition(3) for r, s in ((seen, STATE), (history, HISTORY))]
    found = with_size_as_of(*frames, default, chunk=40)
    assert found.columns == ["job_id", "attempt_id", "created", "first_time", "size"]
    rows = found.collect()
    assert len(rows) == len(seen)
    for r in rows:
        known = [
            (-(2**60) if at is None else at, -(2**60) if seq is None else seq, size)
            for job, at, seq, *size in history
            if job == r.job_id and (at is None or at <= r.first_time)
        ]
        size = max(known)[2] if known else [None] * 3
        assert list(r["size"]) == [x if x is not None else d for x, d in zip(size, (11, 12, 13))]


def test_running_last_over_chunks(spark):
    rng = random.Random(4)
    rows = [("k", i, rng.choice([None, None, i])) for i in range(500)] + [("l", 1, None), ("l", 2, 5), ("l", 3, None)]
    frame = spark.createDataFrame(rows, "key string, arr long, v long").repartition(4)
    for chunk in (7, 10**6):
        got = {(r.key, r.arr): r.out for r in running(frame, ["key"], F.col("v"), "out", how="last", chunk=chunk).collect()}
        for key in "kl":
            last = None
            for k, arr, v in rows:
                if k == key:
                    assert got[k, arr] == last
                    last = v if v is not None else last


def test_rolling_windows_over_chunks_of_time(spark):
    rng = random.Random(6)
    rows = [("j", "a", b, rng.random()) for b in sorted(rng.sample(range(-2000, 4000), 1500))] + [("k", "a", 7, 1.0)]
    points = spark.createDataFrame(rows, "job_id string, attempt_id string, bucket long, v double")
    for length, chunk in ((100, None), (100, 100), (0, None), (5000, 5000)):
        out = rolling(points, length, chunk_ms=chunk)
        got = {(r.job_id, r.bucket): (r.first_bucket, round(r.avg_v, 9), r.max_v, r.n_points, r.is_full) for r in out.collect()}
        assert len(got) == len(rows)
        for job, _, b, _ in rows:
            inside = [(x, v) for j, _, x, v in rows if j == job and b - length <= x <= b]
            first, values = min(inside)[0], [v for _, v in inside]
            avg = round(sum(values) / len(values), 9)
            assert got[job, b][0] == first and got[job, b][2:] == (max(values), len(values), b - first >= length)
            assert abs(got[job, b][1] - avg) < 1e-8
    spread = rolling(points.filter("job_id = 'j'"), 100).repartition(1)  # the window of one key is cut
    assert "_chunk" in spread._jdf.queryExecution().optimizedPlan().toString()
