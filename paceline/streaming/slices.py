"""Tables as streams whose micro-batches are in order, however the files of the table are laid out."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paceline.session import run_dir
from paceline.sources.readers import file_stream

#: Rows of a micro-batch, about.
ROWS = 50_000_000


def by_order(rows: DataFrame, order: Column, size: int = ROWS) -> Column:
    """Number of the slice of about ``size`` rows that a row is in; equal orders are together."""
    slices = -(-rows.count() // size)
    if slices < 2:
        return F.lit(0)
    shares = [k / slices for k in range(1, slices)]
    accuracy = max(10_000, 10 * slices)
    bounds = rows.agg(F.percentile_approx(order, shares, accuracy)).first()[0]
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < order))


@contextmanager
def _idle_batches(spark: SparkSession, allowed: bool) -> Iterator[None]:
    """Whether a query that is started inside may run a batch without input at its end."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(allowed).lower())
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fed(rows: DataFrame, number: Column, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Stream the rows in as many micro-batches as ``number`` has values, in its order.

    The rows are read once and laid out by slice, in many files each. ``run`` starts a query
    that ends with its input, always with the same checkpoint; it is called once a slice.
    """
    spark = rows.sparkSession
    folder = run_dir(spark)
    rows.withColumn("slice", number.cast("int")).write.partitionBy("slice").parquet(f"{folder}/laid")
    laid = spark.read.parquet(f"{folder}/laid")
    numbers = sorted(r[0] for r in laid.select("slice").distinct().collect())
    for k in numbers:
        part = laid.where(F.col("slice") == k).select(*rows.columns)
        part.write.mode("append").parquet(f"{folder}/in")
        with _idle_batches(spark, k == numbers[-1]):
            run(file_stream(spark, f"{folder}/in", rows)).awaitTermination()
