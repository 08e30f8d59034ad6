"""The named queries: every operator over the whole driver tables."""

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.sizes import (
    resize_cores, total_cores, total_memory_mb, within_limit,
)
from paceline.functions.text import full_match
from paceline.functions.times import DAY_MS, to_millis
from paceline.operators import actions as queue
from paceline.operators import buckets, registry, state
from paceline.operators.arrival import gate, newest_per_key, running_count
from paceline.operators.clicks import click_counts
from paceline.operators.fold import fold, read_lives
from paceline.operators.ingest import parse_messages, split_rejects, sub_group
from paceline.operators.tree import build_tree, flatten_tree, split_clashes, split_trees
from paceline.plans import views
from paceline.plans.cycle import issue_round, run_round
from paceline.plans.evaluate import evaluate
from paceline.plans.views import SETTINGS, events, flat_actions, flat_proposals, latest_time
from paceline.sources.readers import decode_clicks, decode_diagnostics
from paceline.session import run_dir
from paceline.sources.writers import (
    encode_click, encode_diagnostics, encode_statistics, record_issued,
)
from paceline.streaming import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return views.messages(events(spark, folder))


def _state(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder)
    kept = read_lives(views.messages(rows)).state
    return state.with_size(kept, views.job_config(rows), views.DEFAULT_SIZE)


def _points(spark: SparkSession, folder: str, **options) -> DataFrame:
    return buckets.bucket(fold(_messages(spark, folder)), width_ms=DAY_MS, **options)


# --- clicks --------------------------------------------------------------------------


@query
def click_count_15s(spark, folder):
    return click_counts(events(spark, folder), page="event_type")


@query
def click_json_encode(spark, folder):
    return events(spark, folder).select("event_id", encode_click(page="event_type"))


@query
def click_json_decode(spark, folder):
    lines = click_json_encode(spark, folder)
    good, _ = decode_clicks(lines)
    return good.select("event_id", "page", to_millis(F.col("ts")).alias("ts"))


@query
def click_rejects(spark, folder):
    """Every seventh line is cut short, every eleventh has no readable time."""
    whole = F.col("value")
    lines = click_json_encode(spark, folder).withColumn(
        "value",
        F.when(F.col("event_id") % 7 == 0, F.expr("substring(value, 1, 20)"))
        .when(F.col("event_id") % 11 == 0, F.regexp_replace(whole, "-2024", "/2024"))
        .otherwise(whole),
    )
    return decode_clicks(lines)[1].select("event_id", "value")


@query
def click_statistics_json(spark, folder):
    return click_count_15s(spark, folder).select(encode_statistics())


# --- diagnostics messages --------------------------------------------------------------


def _lines(spark, folder):
    lines = views.envelopes(events(spark, folder)).select("event_id", "arr", encode_diagnostics())
    cut = F.when(F.col("event_id") % 17 == 0, F.expr("substring(value, 1, 30)"))
    return lines.withColumn("value", cut.otherwise(F.col("value")))


def _parsed(spark, folder):
    return parse_messages(decode_diagnostics(_lines(spark, folder)))


@query
def diagnostics_encode(spark, folder):
    return views.envelopes(events(spark, folder)).select("event_id", encode_diagnostics())


@query
def diagnostics_decode(spark, folder):
    good, _ = split_rejects(_parsed(spark, folder))
    return good.select(
        "event_id", "job_id", "attempt_id", "container", "enabled", "ts", "is_worker", "load"
    )


@query
def diagnostics_tail(spark, folder):
    """The lines as files that are tailed, numbered per job in the order of the lines."""
    lines = reports.tailed(_lines(spark, folder).select("arr", "value"))
    good, _ = split_rejects(parse_messages(decode_diagnostics(lines)))
    return running_count(good, ["job_id"]).select(
        "n", "job_id", "attempt_id", "container", "ts", "is_worker", "load"
    )


@query
def diagnostics_rejects(spark, folder):
    _, bad = split_rejects(_parsed(spark, folder))
    return bad.select("event_id", "reason")


@query
def accepted_messages(spark, folder):
    kept = gate(_messages(spark, folder), ["job_id", "attempt_id"])
    return kept.select("arr", "job_id", "attempt_id", "ts", "is_worker", "load")


@query
def fold_with_resets(spark, folder):
    kept = fold(views.flagged_messages(events(spark, folder)))
    return kept.select("arr", "job_id", "attempt_id", "ts", "live")


@query
def state_with_resets(spark, folder):
    kept = read_lives(views.flagged_messages(events(spark, folder))).state
    return kept.select("job_id", "attempt_id", "created", "first_time", "last_time")


@query
def fold_with_evictions(spark, folder):
    """Three attempts are kept of a job, so forgotten ones come back all the time."""
    kept = fold(views.crowded_messages(events(spark, folder)), max_attempts=3)
    return kept.select("arr", "job_id", "attempt_id", "ts", "live")


@query
def state_with_evictions(spark, folder):
    kept = read_lives(views.crowded_messages(events(spark, folder)), max_attempts=3).state
    return kept.select("job_id", "attempt_id", "created", "first_time", "last_time")


# --- state -------------------------------------------------------------------------------


@query
def job_state(spark, folder):
    return _state(spark, folder).select(
        "job_id", "attempt_id", "created", "first_time", "last_time", "size.*"
    )


@query
def job_state_as_of(spark, folder):
    """The size that was in force on the day when a deployment was first seen."""
    rows = events(spark, folder)
    kept = read_lives(views.messages(rows)).state
    sized = state.with_size_as_of(kept, views.job_config_history(rows), views.DEFAULT_SIZE)
    return sized.select("job_id", "attempt_id", "created", "first_time", "size.*")


@query
def latest_attempt(spark, folder):
    return state.latest_attempts(_state(spark, folder)).select(
        "job_id", "attempt_id", "first_time", "last_time"
    )


@query
def attempts_top_k(spark, folder):
    return state.keep_newest_attempts(_state(spark, folder), 2).select(
        "job_id", "attempt_id", "created"
    )


@query
def removed_attempts(spark, folder):
    """Points left after the first attempt of every click job was removed."""
    first = _state(spark, folder).filter("attempt_id = 'a0' and job_id like 'click-%'")
    (left,) = state.remove_attempts(first, _points(spark, folder))
    return left.groupBy("job_id", "attempt_id").agg(F.count(F.lit(1)).alias("n_points"))


@query
def deployment_age(spark, folder):
    return state.older_than(_state(spark, folder), 5 * DAY_MS).select("job_id", "attempt_id")


@query
def fresh_deployments(spark, folder):
    kept = _state(spark, folder)
    return state.fresh(kept, latest_time(kept), DAY_MS).select("job_id", "attempt_id", "last_time")


@query
def screened_jobs(spark, folder):
    """Which lists each job is on."""
    up, down = SETTINGS.policies
    job = F.col("job_id")
    return state.latest_attempts(_state(spark, folder)).select(
        "job_id",
        full_match(job, SETTINGS.deny).alias("denied"),
        full_match(job, "").alias("denied_by_default"),
        full_match(job, up.allow).alias("may_scale_up"),
        full_match(job, down.allow).alias("may_scale_down"),
    )


@query
def job_totals(spark, folder):
    return _state(spark, folder).select(
        "job_id", "attempt_id",
        total_memory_mb(F.col("size")).alias("total_mb"),
        total_cores(F.col("size")).alias("total_cores"),
    )


@query
def running_counts(spark, folder):
    counted = running_count(_messages(spark, folder), ["job_id"])
    return counted.select("arr", "job_id", "n")


@query
def counts_per_key(spark, folder):
    return _messages(spark, folder).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


# --- series and windows ----------------------------------------------------------------


@query
def bucket_max(spark, folder):
    return _points(spark, folder)


@query
def bucket_sum(spark, folder):
    points = _points(spark, folder, fold="sum")
    return points.withColumn("v", F.round("v", 6))


@query
def bucket_custom_fold(spark, folder):
    """A fold given as a function: the smallest reading of a bucket."""
    return _points(spark, folder, fold=F.min)


@query
def redelivered_sum(spark, folder):
    """Every message twice: the sum needs the copies dropped, the max does not."""
    rows = _messages(spark, folder)
    twice = rows.unionByName(rows)
    once = buckets.dedupe_deliveries(twice, ["arr"], "10 minutes")
    points = buckets.bucket(fold(once), width_ms=DAY_MS, fold="sum")
    return points.withColumn("v", F.round("v", 6))


@query
def retained_window(spark, folder):
    length = buckets.retention_length(*[p.window_ms for p in SETTINGS.policies])
    return buckets.retained(_points(spark, folder), length)


@query
def trailing_window(spark, folder):
    """Half a day more than a whole number of buckets is cut off."""
    return buckets.trailing(_points(spark, folder), 5 * DAY_MS // 2, width_ms=DAY_MS)


@query
def sub_window(spark, folder):
    start = views.START_MS + 3 * DAY_MS
    return buckets.between(_points(spark, folder), start, start + 8 * DAY_MS)


@query
def window_points(spark, folder):
    """The ordered list of every trailing window, with its positions."""
    lists = buckets.as_list(buckets.retained(_points(spark, folder), 3 * DAY_MS))
    rows = lists.select("job_id", "attempt_id", F.posexplode("points").alias("pos", "point"))
    return rows.select("job_id", "attempt_id", "pos", "point.ts", "point.value")


@query
def window_stats(spark, folder):
    stats = buckets.window_stats(buckets.retained(_points(spark, folder), 2 * DAY_MS))
    return stats.withColumns(
        {"avg_v": F.round("avg_v", 6), "max_per_second": F.round("max_per_second", 6)}
    )


@query
def rolling_window(spark, folder):
    rows = buckets.rolling(_points(spark, folder), 2 * DAY_MS)
    return rows.withColumn("avg_v", F.round("avg_v", 6))


@query
def valid_windows(spark, folder):
    stats = buckets.window_stats(
        buckets.trailing(_points(spark, folder), 2 * DAY_MS, width_ms=DAY_MS)
    )
    latest = state.latest_attempts(_state(spark, folder))
    valid = buckets.is_valid_window(
        F.col("first_bucket"), F.col("last_bucket"), 2 * DAY_MS, F.col("first_time"),
        SETTINGS.start_delay_ms,
    )
    rows = latest.join(stats, ["job_id", "attempt_id"])
    return rows.select("job_id", "attempt_id", "first_bucket", "last_bucket", valid.alias("valid"))


@query
def within_limits(spark, folder):
    """Neighbouring points that differ by at most a tenth or at most ten."""
    rows = buckets.rolling(_points(spark, folder), DAY_MS)
    close = within_limit(F.col("v"), F.col("max_v"), 0.1, 10)
    return rows.select("job_id", "attempt_id", "bucket", close.alias("close"))


# --- policies ---------------------------------------------------------------------------


def _evaluate(spark, folder, settings=SETTINGS, **options):
    rows = events(spark, folder)
    return evaluate(
        views.messages(rows), settings, latest_time, job_config=views.job_config(rows), **options
    )


@query
def scale_up(spark, folder):
    return flat_proposals(_evaluate(spark, folder, SETTINGS.only("cpu_scale_up")))


@query
def scale_down(spark, folder):
    return flat_proposals(_evaluate(spark, folder, SETTINGS.only("cpu_scale_down")))


@query
def scale_up_bounded(spark, folder):
    """Scale-up with the usage bounded before it is turned into a size."""
    up = replace(SETTINGS.policies[0], bound=lambda usage: F.least(usage, F.lit(75.0)))
    return flat_proposals(_evaluate(spark, folder, replace(SETTINGS, policies=(up,))))


@query
def evaluate_policies(spark, folder):
    return flat_proposals(_evaluate(spark, folder))


@query
def evaluate_with_pending(spark, folder):
    """Attempts that already have an action are left alone."""
    held = views.held_actions(events(spark, folder), F.col("job_id").like("%-1"))
    return flat_proposals(_evaluate(spark, folder, actions=held))


@query
def evaluate_with_resets(spark, folder):
    rows = events(spark, folder)
    settings = replace(SETTINGS, start_delay_ms=0)
    return flat_proposals(
        evaluate(
            views.flagged_messages(rows), settings, latest_time, job_config=views.job_config(rows)
        )
    )


@query
def all_proposals(spark, folder):
    """The distinct proposals of all policies before one is chosen."""
    return flat_proposals(_evaluate(spark, folder, every=True)).distinct()


@query
def evaluate_from_json(spark, folder):
    """From the JSON lines of the messages to the proposals; rejects are left out."""
    rows = events(spark, folder)
    good, _ = split_rejects(_parsed(spark, folder))
    return flat_proposals(
        evaluate(good, SETTINGS, latest_time, job_config=views.job_config(rows))
    )


@query
def resized(spark, folder):
    """Every deployment resized to the reading of its last bucket."""
    last = buckets.retained(_points(spark, folder), 0)
    size = resize_cores(F.col("size"), F.ceil("v"), views.LIMITS)
    rows = _state(spark, folder).join(last, ["job_id", "attempt_id"])
    return rows.select("job_id", "attempt_id", size.alias("to")).select(
        "job_id", "attempt_id", "to.*"
    )


# --- actions ------------------------------------------------------------------------------


def _actions(spark, folder):
    return views.sizing_actions(events(spark, folder))


@query
def pending_anti_join(spark, folder):
    held = views.held_actions(events(spark, folder), F.col("seq") % 400 == 0)
    return queue.without_action(_state(spark, folder), held).select("job_id", "attempt_id")


@query
def actions_trim(spark, folder):
    return flat_actions(queue.trim(_actions(spark, folder), 20))


@query
def actions_trim_long(spark, folder):
    """The configured queue length, above the optimizer's own limit for early trimming."""
    kept = newest_per_key(_actions(spark, folder), ["type"], "seq", queue.MAX_ACTIONS)
    return flat_actions(kept)


@query
def first_enqueued(spark, folder):
    return flat_actions(queue.next_to_issue(_actions(spark, folder)))


@query
def capacity_join(spark, folder):
    rows = events(spark, folder)
    heads = queue.next_to_issue(views.sizing_actions(rows))
    return flat_actions(queue.with_capacity(heads, views.capacity(rows)))


@query
def issue_actions(spark, folder):
    """The queue after one round of issuing."""
    rows = events(spark, folder)
    after, _ = issue_round(views.sizing_actions(rows), views.capacity(rows))
    return flat_actions(after)


@query
def issue_partly_failed(spark, folder):
    """The queue after a round in which the actions of some jobs could not be applied."""
    rows = events(spark, folder)
    after, _ = issue_round(
        views.sizing_actions(rows),
        lambda: views.capacity(rows),
        lambda issued: issued.filter("job_id not like 'c%'").select("job_id", "seq"),
    )
    return flat_actions(after)


@query
def issued_log(spark, folder):
    """What a log of two rounds holds after the second round was run twice."""
    rows = events(spark, folder)
    path = f"{run_dir(spark)}/issued"
    queue_, limits = views.sizing_actions(rows), views.capacity(rows)
    after, _ = issue_round(queue_, limits, record_issued(path, 0))
    for _ in range(2):
        issue_round(after, limits, record_issued(path, 1))
    return flat_actions(spark.read.parquet(path).select(*queue_.columns))


@query
def action_round(spark, folder):
    """A whole round: evaluate, enqueue, trim, issue."""
    rows = events(spark, folder)
    held = views.held_actions(rows, F.col("job_id").like("%-1"))
    settings = replace(SETTINGS, max_actions=20)
    after, _ = run_round(
        views.messages(rows), held, settings, latest_time, 1_000_000_000,
        job_config=views.job_config(rows), capacity=views.capacity(rows),
    )
    return flat_actions(after)


# --- metric registry -----------------------------------------------------------------------


def _registry(spark, folder):
    return registry.split_scopes(views.registry_log(events(spark, folder)))


@query
def scope_paths(spark, folder):
    rows = _registry(spark, folder)[0]
    text = F.array_join("path", "/").alias("path")
    return rows.select("seq", "scope", text, F.size("path").alias("n"))


@query
def scope_rejects(spark, folder):
    return _registry(spark, folder)[1].select("seq", "scope")


@query
def metric_registry(spark, folder):
    rows = registry.current_metrics(_registry(spark, folder)[0], ["process"])
    return rows.withColumn("path", F.array_join("path", "/"))


@query
def metric_kinds(spark, folder):
    rows = registry.snapshot_kinds(views.registry_log(events(spark, folder)))
    return rows.select("seq", "kind", "value")


@query
def label_conflicts(spark, folder):
    return registry.first_labels(views.label_log(events(spark, folder)), ["process"])


@query
def header_merge(spark, folder):
    merged = registry.header_map(views.label_log(events(spark, folder)), ["process"])
    return merged.select("process", F.to_json("metricHeader").alias("header"))


@query
def snapshot_messages(spark, folder):
    rows = events(spark, folder)
    made = registry.snapshot_messages(
        views.registry_log(rows), views.label_log(rows), ["process"], F.lit(views.START_MS)
    )
    return made.select("process", encode_diagnostics())


@query
def metric_flatten(spark, folder):
    rows = views.envelopes(events(spark, folder))
    leaves = flatten_tree(rows, "metricsSnapshot", ["event_id"])
    return leaves.withColumn("path", F.array_join("path", "/"))


@query
def metric_tree_round_trip(spark, folder):
    rows = views.envelopes(events(spark, folder))
    leaves = flatten_tree(rows, "metricsSnapshot", ["event_id"], empty_groups=True)
    return build_tree(leaves, ["event_id"])


@query
def metric_flatten_deep(spark, folder):
    """Trees of one to 901 levels, very long values and texts without an end in one table."""
    rows = views.deep_trees(events(spark, folder))
    leaves = flatten_tree(rows, "tree", ["event_id"])
    return leaves.withColumn("path", F.array_join("path", "/"))


@query
def metric_flatten_rejects(spark, folder):
    """What cannot be flattened, with the reason, beside the leaves of all other texts."""
    good, bad = split_trees(views.broken_trees(events(spark, folder)), "tree")
    leaves = flatten_tree(good, "tree", ["event_id"])
    return leaves.select("event_id", "name", "value", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("event_id", "reason"), allowMissingColumns=True
    )


@query
def metric_clashes(spark, folder):
    """Metrics that are named like a group of their process."""
    rows = views.clashing_leaves(events(spark, folder))
    return split_clashes(rows, ["process"])[1].select("process", F.array_join("path", "/").alias("path"), "name", "value")


@query
def sub_group_present(spark, folder):
    rows = views.envelopes(events(spark, folder)).withColumn(
        "tree", F.try_parse_json("metricsSnapshot")
    )
    tree = F.col("tree")
    return rows.select(
        "event_id",
        sub_group(tree, "$.taskmanager").isNotNull().alias("worker"),
        sub_group(tree, "$.taskmanager.Status.JVM.CPU").isNotNull().alias("worker_cpu"),
        sub_group(tree, "$.jobmanager.Status.JVM.Heap").isNotNull().alias("manager_heap"),
    )


# --- streams ------------------------------------------------------------------------------


@query
def processing_time_count(spark, folder):
    """Counts by the time of ingestion instead of the time of the click."""
    late = F.make_interval(secs=F.col("event_id") % 60)
    rows = events(spark, folder).withColumn("ingested", F.col("ts") + late)
    return click_counts(rows, time="ingested", page="event_type", watermark=None)


@query
def stream_late_clicks(spark, folder):
    """Counts of a stream of four files in which some clicks come a file late."""
    return reports.late_clicks(spark, folder)


@query
def stream_redelivered_sum(spark, folder):
    """Every message twice in a stream that drops the copies."""
    points = buckets.bucket(fold(reports.delivered_once(spark, folder)), width_ms=DAY_MS, fold="sum")
    return points.withColumn("v", F.round("v", 6))


@query
def stream_click_count(spark, folder):
    return reports.click_count(spark, folder)


@query
def stream_evaluate(spark, folder):
    return flat_actions(reports.evaluated(spark, folder)).drop("seq")


@query
def stream_evaluate_keyed(spark, folder):
    return flat_actions(reports.evaluated_keyed(spark, folder)).drop("seq")


@query
def stream_evaluate_timed(spark, folder):
    """Evaluated by timers alone, after all input was read."""
    return flat_actions(reports.evaluated_by_timers(spark, folder)).drop("seq")
