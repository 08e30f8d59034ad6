"""Time functions. Times travel as epoch millis (bigint), so buckets need no zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: wire pattern of click times. It has a 12-hour clock without a day-half
# marker, so 13:02 is written as 01:02 and cannot be read back as 13:02.
CLICK_PATTERN = "dd-MM-yyyy hh:mm:ss:SSS"

SECOND_MS = 1000
MINUTE_MS = 60 * SECOND_MS
DAY_MS = 24 * 60 * MINUTE_MS


def to_millis(ts: Column) -> Column:
    """Timestamp → epoch millis (the session zone is pinned to UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def bucket_start(ms: Column, width_ms: int = MINUTE_MS) -> Column:
    """Start of the epoch-aligned bucket that holds ``ms``."""
    return ms - F.pmod(ms, F.lit(width_ms).cast("bigint"))


def whole_buckets(length_ms: int, width_ms: int = MINUTE_MS) -> int:
    """Window length cut down to whole buckets."""
    return length_ms // width_ms * width_ms


def format_click_time(ts: Column, pattern: str = CLICK_PATTERN) -> Column:
    return F.date_format(ts, pattern)


def parse_click_time(text: Column, pattern: str | None = CLICK_PATTERN) -> Column:
    """Text → timestamp, null when it does not parse; ``None`` reads ISO-8601."""
    if pattern is None:
        return text.try_cast("timestamp")
    return F.try_to_timestamp(text, F.lit(pattern))
