"""Operators that depend on the order of arrival.

A running value over one key is a window whose partition is the whole key. One key may
hold a third of all rows, so the rows of large keys are cut into chunks of consecutive
arrival numbers: the chunks are pre-aggregated (with map-side combine), the small chunk
table carries the value forward, and the row window only spans a chunk. All other keys are
one chunk each.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.session import saved

# Arrival numbers per chunk, and rows up to which a key is one chunk. With one message per
# arrival number this bounds the rows of one window group.
CHUNK = 1 << 20


def chunk_of(arr: str, width: int) -> Column:
    """Chunk number; never decreases as the arrival number grows."""
    return F.expr(f"`{arr}` div {int(width)}")


def large_keys(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys with more rows than this; counted with map-side combine, no rows are moved."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > rows).select(*keys)


def running(
    df: DataFrame,
    keys: list[str],
    value: Column,
    out: str,
    *,
    arr: str = "arr",
    how: str = "max",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``out``: the max, count or last of ``value`` over the earlier rows of the same key.

    The row itself is not included, nulls do not count. Keys must not be null. Large keys are looked for right
    away. The rows are shuffled once, by (keys, chunk); only those of large keys are
    aggregated and joined with carried values beside that.
    """
    def last(value: str) -> Column:
        return F.last(value, ignorenulls=True)

    fold, merge = {"max": (F.max, F.max), "count": (F.count, F.sum), "last": (last, last)}[how]
    total = fold("_value")
    if how == "last":  # without a window there is no order
        total = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(arr)))
    rows = df.withColumn("_value", value)
    large = saved(large_keys(df, keys, chunk))
    if large.isEmpty():
        order = Window.partitionBy(*keys).orderBy(arr)
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*df.columns, fold("_value").over(earlier).alias(out))

    marked = rows.join(large.withColumn("_large", F.lit(True)), keys, "left")
    rows = marked.withColumn(
        "_chunk", F.when(F.col("_large"), chunk_of(arr, chunk)).otherwise(F.lit(0))
    )
    totals = (
        df.withColumn("_value", value)
        .join(large, keys, "left_semi")
        .groupBy(*keys, chunk_of(arr, chunk).alias("_chunk"))
        .agg(total.alias("_total"))
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_chunk", merge("_total").over(before).alias("_carry")
    ).filter(F.col("_carry").isNotNull())
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(arr).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = rows.withColumn("_local", fold("_value").over(inside))
    joined = local.join(carry, [*keys, "_chunk"], "left")
    if how == "max":
        result = F.greatest("_local", "_carry")
    elif how == "last":
        result = F.coalesce("_local", "_carry")
    else:
        result = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return joined.select(*df.columns, result.alias(out))


def gate(messages: DataFrame, keys: list[str], *, chunk: int = CHUNK) -> DataFrame:
    """Keep a message when no earlier message of its key has a later event time.

    An equal time is kept. Rows that are dropped can never raise the running maximum,
    so the maximum over all earlier rows equals the one over the kept rows.
    """
    seen = running(messages, keys, F.col("ts"), "_last", chunk=chunk)
    return seen.filter(F.col("_last").isNull() | (F.col("ts") >= F.col("_last"))).drop("_last")


def running_count(
    df: DataFrame, keys: list[str], out: str = "n", *, arr: str = "arr", chunk: int = CHUNK
) -> DataFrame:
    """Number of rows of the key up to and including this one."""
    counted = running(df, keys, F.lit(1), out, arr=arr, how="count", chunk=chunk)
    return counted.withColumn(out, F.col(out) + 1)


def newest_per_key(
    df: DataFrame, keys: list[str], order: str, keep: int, *, salts: int = 64
) -> DataFrame:
    """Keep the ``keep`` rows with the highest ``order`` of every key.

    Up to the optimizer's group-limit threshold Spark already trims before the shuffle.
    Above it a salted first pass does: what is among the newest of a key is also among
    the newest of its salt, so a hot key is cut down by many tasks.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    rows = df
    if keep > limit:
        salt = F.pmod(F.xxhash64(order), F.lit(salts))
        part = Window.partitionBy(*keys, salt).orderBy(F.col(order).desc())
        rows = rows.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= keep)
        rows = rows.drop("_rank")
    whole = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    ranked = rows.withColumn("_rank", F.row_number().over(whole))
    return ranked.filter(F.col("_rank") <= keep).drop("_rank")
