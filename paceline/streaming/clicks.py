"""Click counting as a running query."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from paceline.operators.clicks import click_counts
from paceline.sources.writers import encode_statistics, to_bus, to_files


def count_to_files(
    clicks: DataFrame, path: str, checkpoint: str, *, trigger: dict, **options
) -> StreamingQuery:
    """Closed windows, each once, as rows in parquet files."""
    return to_files(click_counts(clicks, **options), path, checkpoint).trigger(**trigger).start()


def count_to_bus(
    clicks: DataFrame, servers: str, topic: str, checkpoint: str, *, trigger: dict, **options
) -> StreamingQuery:
    """Closed windows as JSON statistics on a message bus, at least once."""
    encoded = click_counts(clicks, **options).select(encode_statistics())
    return to_bus(encoded, servers, topic, checkpoint).trigger(**trigger).start()
