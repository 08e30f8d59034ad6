"""Metric series: one value per deployment and time bucket, and windows over them."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.times import MINUTE_MS, bucket_start, whole_buckets

# How values of one bucket are folded: a name or a function from column to aggregate.
Fold = str | Callable[[Column], Column]
FOLDS: dict[str, Callable[[Column], Column]] = {"max": F.max, "sum": F.sum}

KEYS = ["job_id", "attempt_id"]


def bucket(
    messages: DataFrame,
    *,
    keys: list[str] = KEYS,
    width_ms: int = MINUTE_MS,
    fold: Fold = "max",
    value: str = "load",
) -> DataFrame:
    """Worker messages → (keys, bucket, v). Map-side combine does most of the work."""
    use = FOLDS[fold] if isinstance(fold, str) else fold
    workers = messages.filter(F.col("is_worker") & F.col(value).isNotNull())
    start = bucket_start(F.col("ts"), width_ms).alias("bucket")
    return workers.groupBy(*keys, start).agg(use(F.col(value)).alias("v"))


def dedupe_deliveries(messages: DataFrame, ids: list[str], delay: str) -> DataFrame:
    """Drop redelivered messages; needed before a fold that is not idempotent (sum).

    In a stream the remembered ids are bounded by the watermark delay on ``ts``, epoch millis.
    """
    if messages.isStreaming:
        return with_watermark(messages, delay).dropDuplicatesWithinWatermark(ids).drop(EVENT_TIME)
    return messages.dropDuplicates(ids)


EVENT_TIME = "_event_time"


def with_watermark(messages: DataFrame, delay: str) -> DataFrame:
    """Messages of a stream with a watermark on their event time, in a column of its own."""
    timed = messages.withColumn(EVENT_TIME, F.timestamp_millis(F.col("ts")))
    return timed.withWatermark(EVENT_TIME, delay)


def _last(keys: list[str]) -> Column:
    return F.max("bucket").over(Window.partitionBy(*keys))


def retained(points: DataFrame, length_ms: int, *, keys: list[str] = KEYS) -> DataFrame:
    """Points at most ``length_ms`` older than the last point, both ends included."""
    rows = points.withColumn("_last", _last(keys))
    return rows.filter(F.col("_last") - F.col("bucket") <= length_ms).drop("_last")


def retention_length(*lengths_ms: int) -> int:
    """Length to retain so that every window in use can be answered."""
    return max(lengths_ms)


def trailing(
    points: DataFrame, length_ms: int, *, keys: list[str] = KEYS, width_ms: int = MINUTE_MS
) -> DataFrame:
    """Window that ends at the last point; its length is cut down to whole buckets."""
    return retained(points, whole_buckets(length_ms, width_ms), keys=keys)


def between(
    points: DataFrame, start_ms: int | Column, end_ms: int | Column, *, keys: list[str] = KEYS
) -> DataFrame:
    """Sub-window of bucket starts, both ends included, folded again with max."""
    rows = points.filter(F.col("bucket").between(start_ms, end_ms))
    return rows.groupBy(*keys, "bucket").agg(F.max("v").alias("v"))


def as_list(points: DataFrame, *, keys: list[str] = KEYS) -> DataFrame:
    """One row per deployment: its points as an array in bucket order."""
    point = F.struct(F.col("bucket").alias("ts"), F.col("v").alias("value"))
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("points"))


def window_stats(points: DataFrame, *, keys: list[str] = KEYS) -> DataFrame:
    """Extent and averages of a window. The average counts buckets, not messages."""
    return points.groupBy(*keys).agg(
        F.min("bucket").alias("first_bucket"),
        F.max("bucket").alias("last_bucket"),
        (F.max("bucket") - F.min("bucket")).alias("span_ms"),
        F.coalesce(F.max("v"), F.lit(0.0)).alias("max_v"),
        (F.coalesce(F.max("v"), F.lit(0.0)) / 60).alias("max_per_second"),
        F.coalesce(F.avg("v"), F.lit(0.0)).alias("avg_v"),
        F.count(F.lit(1)).alias("n_points"),
    )


def rolling(
    points: DataFrame, length_ms: int, *, keys: list[str] = KEYS, chunk_ms: int | None = None
) -> DataFrame:
    """The trailing window at every point, not only at the last one.

    A key is cut into chunks of time, by default eight windows long. A point within a window's
    length of the end of its chunk is copied to the next one, where it only fills windows. So a
    long history goes to many tasks, and a chunk has at most one row per bucket of its time.
    """
    width = max(chunk_ms or 8 * length_ms, length_ms, 1)
    chunk = F.floor(F.col("bucket") / width)
    later = F.floor((F.col("bucket") + length_ms) / width)
    halo = F.when(later > chunk, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    copied = points.select("*", F.posexplode(halo).alias("_copy", "_chunk"))
    frame = Window.partitionBy(*keys, "_chunk").orderBy("bucket").rangeBetween(-length_ms, 0)
    filled = copied.withColumns(
        {
            "first_bucket": F.min("bucket").over(frame),
            "avg_v": F.avg("v").over(frame),
            "max_v": F.max("v").over(frame),
            "n_points": F.count(F.lit(1)).over(frame),
        }
    )
    return (
        filled.filter("_copy = 0")
        .drop("_copy", "_chunk")
        .withColumn("is_full", F.col("bucket") - F.col("first_bucket") >= length_ms)
    )


def is_valid_window(
    first: Column,
    last: Column,
    length_ms: int,
    first_time: Column,
    start_delay_ms: int,
    tolerance_ms: int = 0,
) -> Column:
    """A decision may use the window: it is not a single point, it is full, and it does
    not reach into the start phase of the deployment."""
    span = last - first
    return F.coalesce(
        (span > 0) & (span >= length_ms - tolerance_ms) & (first >= first_time + start_delay_ms),
        F.lit(False),
    )
