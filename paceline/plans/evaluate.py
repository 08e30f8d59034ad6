"""From messages to proposed size changes."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.text import full_match
from paceline.functions.times import bucket_start, whole_buckets
from paceline.operators.actions import without_action
from paceline.operators.arrival import gate
from paceline.operators.buckets import bucket, is_valid_window
from paceline.operators.fold import LIFE, read_lives
from paceline.operators.state import latest_attempts, with_size
from paceline.plans.policies import Policy, Settings
from paceline.session import saved

Now = int | Column | Callable[[DataFrame], Column]


def evaluate(
    messages: DataFrame,
    settings: Settings,
    now_ms: Now,
    *,
    job_config: DataFrame | None = None,
    actions: DataFrame | None = None,
    every: bool = False,
) -> DataFrame:
    """At most one proposal per job: the first policy, by priority, that wants a change.

    ``now_ms`` is a number, a column, or a function of the state table. With ``every`` the
    proposals of all policies come back, as if each were evaluated alone.
    """
    lives = read_lives(messages, max_attempts=settings.max_attempts, chunk=settings.chunk)
    state = with_size(lives.state, job_config, settings.default_size)
    now = now_ms(state) if callable(now_ms) else now_ms
    # One row per job. Its true size decides whether the messages, which are joined with it
    # twice, stay where they are or are shuffled.
    latest = saved(candidates(latest_attempts(state), settings, now, actions))
    return decide(latest, recent_points(lives.rows, latest, settings), settings, every=every)


def candidates(
    latest: DataFrame, settings: Settings, now_ms: int | Column, actions: DataFrame | None = None
) -> DataFrame:
    """Latest attempts that some policy may act on, found before any metric is read."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    job = F.col("job_id")
    allowed = reduce(Column.__or__, [full_match(job, p.allow) for p in settings.policies])
    kept = latest.filter(
        ~full_match(job, settings.deny)
        & allowed
        & (now - F.col("last_time") <= settings.max_staleness_ms)
    )
    if actions is None:
        return kept
    return without_action(kept, actions, settings.active_statuses)


def recent_points(rows: DataFrame, latest: DataFrame, settings: Settings) -> DataFrame:
    """Metric points of the candidates, as far back as a policy looks.

    The event-time gate drops a row for an earlier row with a later time, so rows before
    a time bound never matter to rows after it, and older rows can be left out before the
    gate shuffles anything. A window ends at the last metric that counts, which is close
    to the last message. So a tail of twice the reach is read first, and its lowest start
    is a plain filter that reaches the scan: a long history is not even read. Attempts
    whose window does not lie inside their tail are read again in full.
    """
    width = settings.granularity_ms
    reach = max(whole_buckets(p.window_ms, width) for p in settings.policies)
    start = bucket_start(F.col("last_time"), width) - 2 * reach - width
    wanted = latest.select(*LIFE, "first_time", "last_metric", start.alias("_from"))
    wanted = wanted.filter(F.col("last_metric").isNotNull())
    lowest = wanted.agg(F.min("_from")).first()[0]
    if lowest is None:
        return _points(rows.limit(0), settings)

    live = rows.filter("live")
    tail = live.filter(F.col("ts") >= lowest).join(wanted.select(*LIFE, "_from"), LIFE)
    found = saved(_points(tail.filter(F.col("ts") >= F.col("_from")).drop("_from"), settings))
    ends = found.groupBy(*LIFE).agg(F.max("bucket").alias("_end"))
    covered = (F.col("first_time") >= F.col("_from")) | (F.col("_end") - reach >= F.col("_from"))
    missed = wanted.join(ends, LIFE, "left").filter(~F.coalesce(covered, F.lit(False)))
    missed = missed.select(*LIFE)
    if missed.isEmpty():
        return found
    missed = saved(missed)
    again = _points(live.join(missed, LIFE, "left_semi"), settings)
    return found.join(missed, LIFE, "left_anti").unionByName(again)


def _points(rows: DataFrame, settings: Settings) -> DataFrame:
    counted = gate(rows, LIFE, chunk=settings.chunk)
    return bucket(counted, keys=LIFE, width_ms=settings.granularity_ms)


def window_columns(points: DataFrame, settings: Settings) -> DataFrame:
    """One row per life: last bucket, and first bucket and average of every policy window."""
    width = settings.granularity_ms
    last = F.max("bucket").over(Window.partitionBy(*LIFE))
    aggregates = [F.max("bucket").alias("last_bucket")]
    for i, policy in enumerate(settings.policies):
        length = whole_buckets(policy.window_ms, width)
        inside = F.col("_last") - F.col("bucket") <= length
        aggregates += [
            F.min(F.when(inside, F.col("bucket"))).alias(f"first_{i}"),
            F.avg(F.when(inside, F.col("v"))).alias(f"usage_{i}"),
        ]
    return points.withColumn("_last", last).groupBy(*LIFE).agg(*aggregates)


def proposal(policy: Policy, i: int, settings: Settings) -> Column:
    """The size change a policy wants as a struct; null for no change."""
    usage, size = F.col(f"usage_{i}"), F.col("size")
    valid = is_valid_window(
        F.col(f"first_{i}"),
        F.col("last_bucket"),
        whole_buckets(policy.window_ms, settings.granularity_ms),
        F.col("first_time"),
        settings.start_delay_ms,
        settings.tolerance_ms,
    )
    # Spark orders NaN above every number; a NaN usage must not trigger anything.
    wanted = ~F.isnan(usage) & policy.required(usage, size["container_num_cores"])
    target = settings.resizer(size, policy.target(policy.bound(usage)), settings.limits)
    acts = full_match(F.col("job_id"), policy.allow) & valid & wanted & ~target.eqNullSafe(size)
    return F.when(
        acts & target.isNotNull(),
        F.struct(
            F.lit(policy.action_type).alias("type"), usage.alias("usage"), target.alias("target")
        ),
    )


def decide(
    latest: DataFrame, points: DataFrame, settings: Settings, *, every: bool = False
) -> DataFrame:
    """Latest attempts and their points → proposals, the first per job or ``every`` one.

    All policies are looked at in the same row, so taking the first one needs no union
    and no further shuffle.
    """
    rows = latest.join(window_columns(points, settings), LIFE)
    wanted = F.array(*[proposal(p, i, settings) for i, p in enumerate(settings.policies)])
    told = F.filter(wanted, lambda x: x.isNotNull())
    return rows.withColumn("_told", F.explode(told if every else F.slice(told, 1, 1))).select(
        "job_id",
        "attempt_id",
        F.col("size").alias("current_size"),
        F.col("_told.target").alias("target_size"),
        F.col("_told.type").alias("type"),
        F.col("_told.usage").alias("usage"),
    )
