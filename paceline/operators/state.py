"""State of deployments: one row per live (job, attempt)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.sizes import JobSize, size_struct
from paceline.operators.arrival import CHUNK, newest_per_key, running
from paceline.operators.fold import ATTEMPT, MAX_ATTEMPTS, summarise


def job_state(rows: DataFrame) -> DataFrame:
    """First and last event time of every live life, and the arrival that created it.

    Takes the rows of ``read_lives`` or the output of ``fold``; both give the same result,
    and so does ``read_lives(...).state``, which costs nothing more.
    """
    return summarise(rows)


def with_size(
    state: DataFrame, job_config: DataFrame | None, default: JobSize = JobSize()
) -> DataFrame:
    """Attach the configured size; a job without configuration gets the default.

    The join carries no hint: Spark broadcasts the configuration only while its measured
    size is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    names = ["container_mb", "container_num_cores", "container_count"]
    if job_config is None:
        joined = state.withColumns({n: F.lit(None).cast("int") for n in names})
    else:
        joined = state.join(job_config.select("job_id", *names), "job_id", "left")
    size = size_struct(*[F.coalesce(F.col(n), F.lit(getattr(default, n))) for n in names])
    return joined.withColumn("size", size).drop(*names)


SINCE_EVER = -(2**60)


def with_size_as_of(
    state: DataFrame,
    history: DataFrame,
    default: JobSize = JobSize(),
    *,
    at: str = "first_time",
    chunk: int = CHUNK,
) -> DataFrame:
    """Attach the size that was configured when a deployment was first seen.

    ``history`` is (job_id, valid_from, seq, container columns): a row is in force from
    ``valid_from``, epoch millis, that moment included, until the next one of its job. Of rows
    from the same moment the one with the highest ``seq`` counts; a null moment is since ever. Before
    the first row, and for jobs without any, the default holds.

    Sightings and rows of the history are put in one order per job, and the last row is carried
    forward, so the join matches no pairs; a job with many of either is cut into chunks of time.
    """
    names = ["container_mb", "container_num_cores", "container_count"]
    moment = F.coalesce("valid_from", F.lit(SINCE_EVER))
    rows = (
        history.filter(F.col("job_id").isNotNull())
        .groupBy("job_id", moment.alias("_time"))
        .agg(F.max_by(F.struct(*names), F.coalesce("seq", F.lit(SINCE_EVER))).alias("_size"))
        .select("job_id", (F.col("_time") * 2).alias("_place"), "_size")
    )
    seen = state.withColumn("_place", F.col(at) * 2 + 1)
    both = seen.withColumn("_seen", F.lit(True)).unionByName(rows, allowMissingColumns=True)
    told = running(both, ["job_id"], F.col("_size"), "_now", arr="_place", how="last", chunk=chunk)
    size = size_struct(*[F.coalesce(F.col("_now")[n], F.lit(getattr(default, n))) for n in names])
    return told.filter("_seen").withColumn("size", size).drop("_place", "_size", "_seen", "_now")


def latest_attempts(state: DataFrame) -> DataFrame:
    """Per job the attempt that was created last, with its whole state row.

    Only numbers are aggregated; the row is joined to its own number afterwards, as arrival
    numbers tell attempts of a job apart.
    """
    newest = state.groupBy("job_id").agg(F.max("created").alias("created"))
    return state.join(newest, ["job_id", "created"], "left_semi")


def keep_newest_attempts(state: DataFrame, keep: int = MAX_ATTEMPTS) -> DataFrame:
    """At most ``keep`` attempts per job, the last created ones."""
    return newest_per_key(state, ["job_id"], "created", keep)


def remove_attempts(
    to_delete: DataFrame, *tables: DataFrame, keys: list[str] = ATTEMPT
) -> list[DataFrame]:
    """Remove a list of (job, attempt) from every derived table.

    A job whose attempts are all removed has no row left in any of them.
    """
    gone = to_delete.select(*keys).distinct()
    return [table.join(gone, keys, "left_anti") for table in tables]


def fresh(state: DataFrame, now_ms: Column, max_staleness_ms: int) -> DataFrame:
    """Deployments heard of within the last ``max_staleness_ms`` before ``now_ms``."""
    return state.filter(now_ms - F.col("last_time") <= max_staleness_ms)


def older_than(state: DataFrame, period_ms: int) -> DataFrame:
    """Deployments whose known life is strictly longer than the period."""
    return state.filter(F.col("last_time") - F.col("first_time") > period_ms)
