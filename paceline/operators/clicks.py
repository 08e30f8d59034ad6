"""Click counts per page and tumbling event-time window, for tables and streams alike."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = "15 seconds"
WATERMARK = "200 milliseconds"


def click_counts(
    clicks: DataFrame,
    *,
    time: str = "ts",
    page: str = "page",
    window: str = WINDOW,
    watermark: str | None = WATERMARK,
    spread: int | None = None,
) -> DataFrame:
    """Count per (page, window); windows are epoch-aligned and half-open.

    ``time`` may name an ingestion-time column for processing-time counts. A stream drops
    rows that come later than the watermark. ``spread`` deals the rows out evenly to that
    many tasks first, which only pays off when the input is badly split; it is not by page,
    because one page may hold a large part of the clicks.
    """
    rows = clicks.withWatermark(time, watermark) if clicks.isStreaming and watermark else clicks
    if spread:
        rows = rows.repartition(spread)
    counted = rows.groupBy(F.window(time, window).alias("w"), F.col(page).alias("page")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "page", "count"
    )

