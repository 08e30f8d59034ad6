"""Sources. The decoders take any DataFrame with a text or binary ``value`` column, so
they work on files, tables and message buses, batch or streaming."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.rows import compute_once
from paceline.functions.times import CLICK_PATTERN, parse_click_time
from paceline.schemas import CLICK_JSON, DIAGNOSTICS_JSON


def bus_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    *,
    starting: str = "latest",
    per_batch: int = 50_000_000,
    **options,
) -> DataFrame:
    """Message-bus source (needs the Kafka connector jar of the cluster); ``per_batch`` bounds
    the messages of a micro-batch.

    ``arr`` is the offset. Producers that key by job put all messages of a job into one
    partition, so the offset orders the messages of every job.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    reader = reader.option("subscribe", topic).option("startingOffsets", starting)
    reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return with_bus_arrival(reader.options(**options).load())


def bus_table(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """The content of a topic as a table."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers)
    return with_bus_arrival(reader.option("subscribe", topic).options(**options).load())


def with_bus_arrival(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("value").cast("string").alias("value"), "partition", F.col("offset").alias("arr")
    )


def file_stream(
    spark: SparkSession, glob: str, like: DataFrame, *, per_batch: int | None = None, **options
) -> DataFrame:
    """Stream over parquet files; the schema is taken from a table of the same shape.

    ``per_batch`` bounds the files of a micro-batch. Rows behind a watermark are lost to what
    uses one, so give it only where files are in order of event time; else feed the stream by
    :func:`paceline.streaming.slices.fed`.
    """
    reader = spark.readStream.schema(like.schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.options(**options).parquet(glob)


def text_lines(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Lines of text files as ``value``."""
    return spark.readStream.text(path) if stream else spark.read.text(path)


def decode_clicks(
    records: DataFrame, *, value: str = "value", pattern: str | None = CLICK_PATTERN
) -> tuple[DataFrame, DataFrame]:
    """(click rows ``ts, page`` with the other columns, rejected input rows)."""
    rest = [c for c in records.columns if c not in {value, "ts", "page"}]
    rows = compute_once(
        records, F.from_json(value, CLICK_JSON), ["_time", "_page"], records.columns
    )
    time = F.struct(parse_click_time(F.col("_time"), pattern))
    rows = compute_once(rows, time, ["_ts"], [*records.columns, "_page"])
    good = rows.filter(F.col("_ts").isNotNull())
    good = good.select(F.col("_ts").alias("ts"), F.col("_page").alias("page"), *rest)
    return good, rows.filter(F.col("_ts").isNull()).select(*records.columns)


def decode_diagnostics(records: DataFrame, *, value: str = "value") -> DataFrame:
    """JSON text → envelope columns next to the other columns.

    Text that is no JSON object leaves ``metricHeader`` null; ``parse_messages`` reports
    such rows as malformed.
    """
    rest = [c for c in records.columns if c != value]
    message = F.from_json(F.col(value).cast("string"), DIAGNOSTICS_JSON)
    return compute_once(records, message, DIAGNOSTICS_JSON.names, rest)


def job_config_from_properties(properties: DataFrame) -> DataFrame:
    """(job_id, key, value) rows → one configuration row per job."""
    # Property names of a job's size.
    names = {
        "container_mb": "job.autoscaling.container.memory.mb",
        "container_num_cores": "job.autoscaling.container.num.cores",
        "container_count": "job.autoscaling.container.count",
    }

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("key") == name, F.col("value").try_cast("int")))

    return properties.groupBy("job_id").agg(*[pick(n).alias(c) for c, n in names.items()])
