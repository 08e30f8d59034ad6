"""Streaming jobs on files that arrive one after the other."""

import json

import pytest
from pyspark.sql import functions as F

from paceline.functions.sizes import CoreLimits, JobSize
from paceline.operators.buckets import dedupe_deliveries
from paceline.operators.clicks import click_counts
from paceline.plans.evaluate import evaluate
from paceline.plans.policies import Settings
from paceline.schemas import MESSAGES
from paceline.sources.readers import decode_clicks, text_lines
from paceline.sources.writers import to_files
from paceline.streaming.clicks import count_to_files
from paceline.streaming.scaler import Scaler, StateTables
from tests import model
from tests.test_fold import frame, messages
from tests.test_policies import POLICIES

NOW = {"availableNow": True}


def test_closed_form_of_the_click_generator(spark):
    """Nine pages, one click per page every 30 ms: five hundred clicks per page and window."""
    ticks = spark.range(500 * 3).select(F.timestamp_millis(F.col("id") * 30).alias("ts"))
    pages = spark.range(9).select(F.format_string("page-%d", "id").alias("page"))
    paged = F.explode(F.array(*[F.lit(r.page) for r in pages.collect()]))
    counts = click_counts(ticks.withColumn("page", paged), spread=4).collect()
    assert len(counts) == 27 and {r["count"] for r in counts} == {500}
    assert {r.window_end.timestamp() - r.window_start.timestamp() for r in counts} == {15}


def test_late_clicks_are_dropped_and_closed_windows_come_once(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in").mkdir()

    def put(name, *seconds):
        lines = [
            json.dumps({"timestamp": f"2024-01-01T00:00:{s:06.3f}Z", "page": "page-1"})
            for s in seconds
        ]
        (tmp_path / "in" / name).write_text("\n".join(lines))

    def run():
        clicks, _ = decode_clicks(text_lines(spark, source, stream=True), pattern=None)
        count_to_files(clicks, out, log, trigger=NOW).awaitTermination()
        rows = spark.read.parquet(out).orderBy("window_start").collect()
        return [(r.window_start.second, r["count"]) for r in rows]

    put("a", 1, 2, 14.9, 16)
    assert run() == [(0, 3)]
    put("b", 3, 29, 30.3)  # the first click is late
    assert run() == [(0, 3), (15, 2)]
    put("c", 50)
    assert run() == [(0, 3), (15, 2), (30, 1)]


@pytest.mark.parametrize("seed,off,max_attempts", [(36, 0.0, 100), (37, 0.02, 100), (24, 0.1, 3)])
def test_scaler_state_after_many_batches(spark, tmp_path, seed, off, max_attempts):
    """Micro-batches in order of arrival end in the state of one sequential reading."""
    rows = messages(seed, 1500, jobs=5, attempts=6 if max_attempts < 10 else 2, off=off)
    cuts = [0, 200, 201, 900, 1500]
    settings = Settings(
        policies=POLICIES, limits=CoreLimits(8, 14), default_size=JobSize(1024, 5, 2),
        max_attempts=max_attempts, chunk=50, max_staleness_ms=400_000,
    )
    now = max(r["ts"] for r in rows)
    scaler = Scaler(StateTables(str(tmp_path / "state"), slots=2), settings, now_ms=now)
    for step, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = frame(spark, rows[a:b])
        scaler.step(batch, step)
        if step == 2:
            scaler.step(batch, step)  # run again after a failure

    assert len(list((tmp_path / "state" / "scratch").iterdir())) == 2
    _, jobs = model.read(rows, max_attempts=max_attempts, length_ms=300_000)
    attempts = scaler.tables.read(spark, "attempts", scaler.last_step).collect()
    assert {(r.job_id, r.attempt_id, r.created, r.first_time, r.last_time) for r in attempts} == {
        (j, a, s.created, s.first, s.last) for j, known in jobs.items() for a, s in known.items()
    }
    points = scaler.tables.read(spark, "points", scaler.last_step).collect()
    assert {(r.job_id, r.attempt_id, r.bucket, r.v) for r in points} == {
        (j, a, b, v) for j, known in jobs.items() for a, s in known.items()
        for b, v in s.points.items()
    }


@pytest.mark.parametrize("copies,ids", [(1, None), (2, ["job_id", "arr"])])
def test_scaler_on_a_file_stream(spark, tmp_path, copies, ids):
    rows = messages(36, 2000, jobs=8, attempts=2)
    for row in rows:
        if int(row["job_id"][1:]) % 2:
            row["load"] = round(row["load"] * 0.4, 2)
    settings = Settings(
        policies=POLICIES, limits=CoreLimits(8, 14), default_size=JobSize(1024, 5, 2),
        max_staleness_ms=10**9,
    )
    source = str(tmp_path / "in")
    frame(spark, rows * copies).coalesce(1).write.parquet(source)
    scaler = Scaler(StateTables(str(tmp_path / "state")), settings, now_ms=rows[-1]["ts"])
    stream = spark.readStream.schema(MESSAGES).parquet(source)
    scaler.start(stream, str(tmp_path / "log"), trigger=NOW, ids=ids).awaitTermination()
    queue = scaler.tables.read(spark, "actions", scaler.last_step).collect()
    expected = evaluate(frame(spark, rows), settings, rows[-1]["ts"]).collect()
    assert expected and {(r.job_id, r.type, r.target_size) for r in queue} == {
        (r.job_id, r.type, r.target_size) for r in expected
    }
    assert {r.status for r in queue} == {"ISSUED"}


def test_the_size_is_frozen_when_a_deployment_is_first_seen(spark, tmp_path):
    first, second = messages(1, 50, jobs=1, attempts=1), messages(2, 50, jobs=1, attempts=1)
    for row in second:
        row["arr"] += 50
    tables = StateTables(str(tmp_path / "state"))
    config = "job_id string, container_mb int, container_num_cores int, container_count int"
    for step, (rows, cores) in enumerate([(first, 5), (second, 9)]):
        made = spark.createDataFrame([("j0", 1, cores, 1)], config)
        Scaler(tables, Settings(), job_config=made).step(frame(spark, rows), step)
    assert [r.size.container_num_cores for r in tables.read(spark, "attempts", 1).collect()] == [5]


def test_redelivered_messages_are_dropped(spark):
    rows = frame(spark, messages(3, 40))
    assert dedupe_deliveries(rows.unionByName(rows), ["arr"], "1 minute").count() == 40


def test_redelivered_messages_are_dropped_in_a_stream(spark, tmp_path):
    rows = frame(spark, messages(3, 40))
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    once = dedupe_deliveries(stream, ["arr"], "1 minute")
    assert once.columns == rows.columns
    to_files(once, str(tmp_path / "out"), str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_a_round_without_input_retries_what_was_held_back(spark, tmp_path):
    """The capacity is read anew in every round."""
    free = [0]
    proposed = [("j", "a", 4, 6)]

    def capacity():
        return spark.createDataFrame([("j", free[0], 10**6)], "job_id string, free_cores int, free_mb int")

    tables = StateTables(str(tmp_path / "state"))
    scaler = Scaler(tables, Settings(), now_ms=0, capacity=capacity)
    size = "named_struct('container_mb', 1024, 'container_num_cores', {}, 'container_count', 1)"
    rows = spark.createDataFrame(proposed, "job_id string, attempt_id string, c int, t int").selectExpr(
        "0L as seq", "job_id", "attempt_id", size.format("c") + " as current_size",
        size.format("t") + " as target_size", "'ENQUEUED' as status", "'JOB_VCORE_SCALEUP' as type",
    )
    scaler.step(frame(spark, messages(3, 5)), 0)
    tables.write(rows, "actions", 0)
    assert [r.status for r in scaler.tick(spark).collect()] == ["ENQUEUED"]
    free[0] = 2
    assert [r.status for r in scaler.tick(spark).collect()] == ["ISSUED"]


def test_batches_are_in_order_whatever_the_order_of_files(spark, tmp_path):
    """Sixteen files without order, eight batches: no click is late, no message is lost or doubled."""
    from paceline.streaming import reports

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(16, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path)
    one = reports.click_count(spark, folder)
    assert one.count() and sorted(reports.click_count(spark, folder, 130).collect()) == sorted(one.collect())
    once = reports.delivered_once(spark, folder, 130).select("arr").collect()
    assert len(once) == len(set(once)) == rows.count()


def test_slices_have_about_the_same_size(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"))
    from paceline.streaming.slices import by_order

    sizes = rows.groupBy(by_order(rows, F.col("n"), 130).alias("k")).agg(F.count("*").alias("n"), F.min("n"), F.max("n"))
    found = [tuple(r) for r in sizes.orderBy("k").collect()]
    assert [k for k, *_ in found] == list(range(8)) and all(120 <= n <= 130 for _, n, *_ in found)
    assert all(a[3] < b[2] for a, b in zip(found, found[1:]))
    assert {r.k for r in rows.limit(0).select(by_order(rows.limit(0), F.col("n"), 5).alias("k")).collect()} == set()
