"""Job sizes and the sizing arithmetic."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JobSize:
    """Default size of a job that has no row in the configuration table."""

    container_mb: int = 1024
    container_num_cores: int = 4
    container_count: int = 1


def size_struct(mb: Column, cores: Column, count: Column) -> Column:
    return F.struct(
        mb.cast("int").alias("container_mb"),
        cores.cast("int").alias("container_num_cores"),
        count.cast("int").alias("container_count"),
    )


def total_memory_mb(size: Column) -> Column:
    return size["container_mb"].cast("bigint") * size["container_count"]


def total_cores(size: Column) -> Column:
    return size["container_num_cores"].cast("bigint") * size["container_count"]


@dataclass(frozen=True)
class CoreLimits:
    """Upper limits of a resize. The memory limits are carried but no rule reads them."""

    per_container: int = 15
    per_job: int = 7500
    container_mb: int = 12288
    job_mb: int = 1019200


def resize_cores(size: Column, target_per_container: Column, limits: CoreLimits) -> Column:
    """Size with a new core count, kept inside the limits.

    A size the user configured above the limit is not reduced to the limit, and a
    container keeps at least one core. Null when the job has no containers.
    """
    count = size["container_count"].cast("bigint")
    wanted = target_per_container.cast("bigint") * count
    limit = F.least(count * limits.per_container, F.lit(limits.per_job).cast("bigint"))
    total = F.when(wanted > limit, F.greatest(total_cores(size), limit)).otherwise(wanted)
    per_container = F.greatest(
        F.floor(F.try_divide(total, count)).cast("bigint"), F.lit(1).cast("bigint")
    )
    resized = size_struct(size["container_mb"], per_container, size["container_count"])
    return F.when(count != 0, resized)


def within_limit(smaller: Column, larger: Column, fraction: float, limit: float) -> Column:
    """True when two values differ by at most a fraction or at most an amount."""
    gap = larger - smaller
    # Division by zero means minus infinity, NaN or plus infinity, by the sign of the
    # gap: only a negative gap is below the fraction then.
    share = F.when(larger == 0, gap < 0).otherwise(F.try_divide(gap, larger) <= fraction)
    return share | (gap <= limit)
