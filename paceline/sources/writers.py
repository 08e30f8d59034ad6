"""Sinks and encoders. An encoder gives one text column ``value`` per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from paceline.functions.times import CLICK_PATTERN, format_click_time


def encode_click(*, ts: str = "ts", page: str = "page", pattern: str = CLICK_PATTERN) -> Column:
    return F.to_json(
        F.struct(
            format_click_time(F.col(ts), pattern).alias("timestamp"), F.col(page).alias("page")
        ),
        {"ignoreNullFields": "false"},
    ).alias("value")


def encode_statistics(pattern: str = CLICK_PATTERN) -> Column:
    """Statistics row (window_start, window_end, page, count) → JSON text."""
    return F.to_json(
        F.struct(
            format_click_time(F.col("window_start"), pattern).alias("windowStart"),
            format_click_time(F.col("window_end"), pattern).alias("windowEnd"),
            F.col("page"),
            F.col("count"),
        ),
        {"ignoreNullFields": "false"},
    ).alias("value")


def encode_diagnostics(tree: Column | None = None) -> Column:
    """Envelope row → JSON text.

    The tree is JSON text, by default the column ``metricsSnapshot``, and goes in as it is,
    so no level of it is parsed again. For a variant pass ``to_json`` of it.
    """
    return F.concat(
        F.lit('{"metricHeader":'),
        F.to_json("metricHeader"),
        F.lit(',"metricsSnapshot":'),
        F.col("metricsSnapshot") if tree is None else tree,
        F.lit(',"autoScalingEnabled":'),
        F.col("autoScalingEnabled").cast("string"),
        F.lit(',"timestamp":'),
        F.col("timestamp").cast("string"),
        F.lit("}"),
    ).alias("value")


def to_bus(values: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Write encoded rows to a message bus, at least once."""
    writer = values.select("value").writeStream.format("kafka")
    writer = writer.option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("checkpointLocation", checkpoint)


def to_files(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write rows to parquet files, exactly once."""
    writer = rows.writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint)


def record_issued(path: str, step: int):
    """Enforcer that records the issued actions of a step in a table; all of them count as
    applied. A step that runs again replaces what it recorded."""

    def enforce(issued: DataFrame) -> None:
        issued.write.mode("overwrite").parquet(f"{path}/step={step}")

    return enforce
