"""The queue of sizing actions, one per job, kept as a table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.sizes import total_cores, total_memory_mb
from paceline.operators.arrival import newest_per_key

MAX_ACTIONS = 2_000
KEYS = ["job_id", "attempt_id"]


def without_action(
    attempts: DataFrame, actions: DataFrame, statuses: tuple[str, ...] | None = None
) -> DataFrame:
    """Attempts that have no action (in one of the statuses; by default in any)."""
    held = actions if statuses is None else actions.filter(F.col("status").isin(*statuses))
    return attempts.join(held.select(*KEYS).distinct(), KEYS, "left_anti")


def enqueue(actions: DataFrame, proposals: DataFrame, seq: int | Column) -> DataFrame:
    """Append proposals to their job's queue. ``seq`` is the round: a job has at most one
    proposal per round, so it orders the queue of every job."""
    added = proposals.select(
        (F.lit(seq) if isinstance(seq, int) else seq).cast("bigint").alias("seq"),
        *KEYS,
        "current_size",
        "target_size",
        F.lit("ENQUEUED").alias("status"),
        "type",
    )
    return actions.unionByName(added)


def trim(actions: DataFrame, keep: int = MAX_ACTIONS) -> DataFrame:
    """Keep the newest actions of every job."""
    return newest_per_key(actions, ["job_id"], "seq", keep)


def next_to_issue(actions: DataFrame) -> DataFrame:
    """The first enqueued action of every job, in queue order.

    The lowest number is found by a hash aggregate with map-side combine; only then is its
    row looked up, so the queue is not sorted.
    """
    waiting = actions.filter(F.col("status") == "ENQUEUED")
    first = waiting.groupBy("job_id").agg(F.min("seq").alias("seq"))
    return waiting.join(first, ["job_id", "seq"], "left_semi").select(*actions.columns)


def with_capacity(actions: DataFrame, capacity: DataFrame | None) -> DataFrame:
    """Actions whose additional cores and memory are free.

    No capacity row means no limit. An unknown current size counts as nothing in use.
    """
    if capacity is None:
        return actions
    current, target = F.col("current_size"), F.col("target_size")
    cores = total_cores(target) - F.coalesce(total_cores(current), F.lit(0))
    memory = total_memory_mb(target) - F.coalesce(total_memory_mb(current), F.lit(0))
    fits = (F.col("free_cores").isNull() | (cores <= F.col("free_cores"))) & (
        F.col("free_mb").isNull() | (memory <= F.col("free_mb"))
    )
    rows = actions.join(capacity.select("job_id", "free_cores", "free_mb"), "job_id", "left")
    return rows.filter(fits).select(*actions.columns)


def mark_issued(actions: DataFrame, issued: DataFrame) -> DataFrame:
    """The queue with the issued actions set to ISSUED; all others stay as they are."""
    done = issued.select("job_id", "seq", F.lit(True).alias("_done"))
    return actions.join(done, ["job_id", "seq"], "left").select(*[
        F.when(F.col("_done"), F.lit("ISSUED")).otherwise(F.col("status")).alias("status")
        if c == "status"
        else F.col(c)
        for c in actions.columns
    ])
