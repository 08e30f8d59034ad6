"""The driver tables sent through the streaming jobs until all input is used up."""

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paceline.operators.buckets import dedupe_deliveries
from paceline.plans import views
from paceline.session import run_dir
from paceline.sources.readers import file_stream
from paceline.sources.tail import tail_lines
from paceline.sources.writers import to_files
from paceline.streaming.clicks import count_to_files
from paceline.streaming.keyed import KeyedScaler
from paceline.streaming.scaler import Scaler, StateTables
from paceline.streaming.slices import ROWS, by_order, fed

ALL_INPUT = {"availableNow": True}


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return file_stream(spark, f"{folder}/events*.parquet", views.events(spark, folder))


def _wall_clock(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


def _counted(rows: DataFrame, number: Column) -> DataFrame:
    """Counts of the clicks of a table that comes in slices."""
    spark = rows.sparkSession
    run = run_dir(spark)

    def start(clicks: DataFrame) -> StreamingQuery:
        # A watermark needs an instant; the tables hold wall-clock times that mean UTC.
        clicks = clicks.withColumn("ts", F.col("ts").cast("timestamp"))
        return count_to_files(
            clicks, f"{run}/counts", f"{run}/checkpoint", trigger=ALL_INPUT, page="event_type"
        )

    fed(rows, number, start)
    return _wall_clock(spark.read.parquet(f"{run}/counts"))


def click_count(spark: SparkSession, folder: str, size: int = ROWS) -> DataFrame:
    """Counts of the windows that closed; the last ones still wait for later clicks.

    The clicks come by time in batches of about ``size``, so none is late in whatever order
    the files of the table are.
    """
    rows = views.events(spark, folder).select("ts", "event_type")
    return _counted(rows, by_order(rows, F.col("ts"), size))


def late_clicks(spark: SparkSession, folder: str, slices: int = 4) -> DataFrame:
    """Counts of clicks that come in slices by time, every fiftieth of the first half two later.

    A slice is a micro-batch. A batch drops what is older than the watermark that the batch
    before it began with, so a click that comes one slice late still counts.
    """
    rows = views.events(spark, folder).select("event_id", "ts", "event_type")
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    micros = {k: F.unix_micros(F.lit(ends[k]).cast("timestamp_ntz").cast("timestamp")) for k in "ab"}
    place = F.unix_micros(F.col("ts").cast("timestamp")) - micros["a"]
    width = micros["b"] + 1 - micros["a"]
    number = F.floor(place * slices / width)
    late = (F.col("event_id") % 50 == 0) & (number < slices - 2)
    return _counted(rows, number + F.when(late, 2).otherwise(0))


def delivered_once(spark: SparkSession, folder: str, size: int = ROWS) -> DataFrame:
    """The messages of a stream that brings every one twice, after the copies were dropped."""
    run = run_dir(spark)

    def start(rows: DataFrame) -> StreamingQuery:
        messages = views.messages(rows)
        twice = messages.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
        once = dedupe_deliveries(twice, ["arr"], "10 minutes")
        return to_files(once, f"{run}/once", f"{run}/checkpoint").trigger(**ALL_INPUT).start()

    rows = views.events(spark, folder).select("event_id", "user_id", "ts", "event_type", "value")
    fed(rows, by_order(rows, F.col("ts"), size), start)
    return spark.read.parquet(f"{run}/once")


def tailed(lines: DataFrame) -> DataFrame:
    """Lines (arr, value), written as files in the order of arr and read by the tail of a stream."""
    spark = lines.sparkSession
    run = run_dir(spark)
    lines.repartitionByRange("arr").sortWithinPartitions("arr").select("value").write.text(f"{run}/in")
    stream = tail_lines(spark, f"{run}/in")
    to_files(stream, f"{run}/lines", f"{run}/checkpoint").trigger(**ALL_INPUT).start().awaitTermination()
    return spark.read.parquet(f"{run}/lines")


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    """The action queue after the scaler has read all events as messages."""
    run = run_dir(spark)
    rows = views.events(spark, folder)
    scaler = Scaler(
        StateTables(f"{run}/state"),
        views.SETTINGS,
        now_ms=views.latest_time,
        job_config=views.job_config(rows),
    )
    messages = views.messages(_event_stream(spark, folder))
    scaler.start(messages, f"{run}/checkpoint", trigger=ALL_INPUT).awaitTermination()
    return scaler.tables.read(spark, "actions", scaler.last_step)


def _keyed(spark: SparkSession, folder: str, run: str, interval_ms: int | None) -> KeyedScaler:
    return KeyedScaler(
        StateTables(f"{run}/state"),
        views.SETTINGS,
        job_config=views.job_config(views.events(spark, folder)),
        interval_ms=interval_ms,
        event_time=True,
    )


def evaluated_keyed(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`evaluated`, with the state of jobs in a state store."""
    run = run_dir(spark)
    scaler = _keyed(spark, folder, run, None)
    messages = views.messages(_event_stream(spark, folder))
    scaler.start(messages, f"{run}/checkpoint", trigger=ALL_INPUT).awaitTermination()
    return scaler.tables.read(spark, "actions", scaler.last_step)


def evaluated_by_timers(spark: SparkSession, folder: str, patience_s: int = 600) -> DataFrame:
    """The queue after two rounds that only timers started, long after the last message was read."""
    run = run_dir(spark)
    scaler = _keyed(spark, folder, run, 2000)
    messages = views.messages(_event_stream(spark, folder))
    running = scaler.start(messages, f"{run}/checkpoint", trigger={"processingTime": "1 second"})
    end = time.monotonic() + patience_s
    try:
        while scaler.heard < 2 and time.monotonic() < end and running.isActive:
            time.sleep(0.2)
    finally:
        running.stop()
    if scaler.heard < 2:
        raise TimeoutError("no timer fired in time")
    return scaler.tables.read(spark, "actions", scaler.last_step)
