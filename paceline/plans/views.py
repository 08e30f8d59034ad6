"""The driver tables seen as clicks, messages, actions and registry logs.

All of it is derived by column expressions from ``events``; nothing is made up on the side.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.sizes import CoreLimits, JobSize, size_struct
from paceline.functions.times import DAY_MS, to_millis
from paceline.plans.policies import Settings, cpu_scale_down, cpu_scale_up
from paceline.session import prepare

START_MS = 1_704_067_200_000  # 2024-01-01, the first day of the events
DAYS_PER_ATTEMPT = 10

DEFAULT_SIZE = JobSize(container_mb=1024, container_num_cores=60, container_count=1)
LIMITS = CoreLimits(per_container=120, per_job=300)

SETTINGS = Settings(
    policies=(
        cpu_scale_up(window_ms=2 * DAY_MS, trigger=1.1, margin=0.0, allow=".*-([0-9]|1[0-7])"),
        cpu_scale_down(window_ms=2 * DAY_MS, trigger=0.5, margin=0.0, allow="[a-z]+-.*"),
    ),
    limits=LIMITS,
    max_staleness_ms=3 * DAY_MS,
    deny="signup-1[0-2]",
    granularity_ms=DAY_MS,
    default_size=DEFAULT_SIZE,
)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/events.parquet")


def latest_time(state: DataFrame) -> Column:
    """The clock of the reports: the last time any deployment was heard of."""
    return state.agg(F.max("last_time")).scalar()


def _late_by() -> Column:
    """Up to 40 places by which a message arrives after its turn."""
    return (F.col("event_id") * 7919) % 41


def arrival() -> Column:
    """Arrival number: delayed event order, ties by event id."""
    return (F.col("event_id") + _late_by()) * 41 + (40 - _late_by())


def job_id() -> Column:
    return F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string"))


def attempt_id(ts_ms: Column) -> Column:
    age = F.floor((ts_ms - START_MS) / (DAYS_PER_ATTEMPT * DAY_MS))
    return F.concat(F.lit("a"), age.cast("string"))


def messages(rows: DataFrame) -> DataFrame:
    """Events as diagnostics messages; all of them enabled."""
    ts = to_millis(F.col("ts"))
    return rows.select(
        arrival().alias("arr"),
        job_id().alias("job_id"),
        attempt_id(ts).alias("attempt_id"),
        F.col("user_id").cast("string").alias("container"),
        F.lit(True).alias("enabled"),
        ts.alias("ts"),
        (F.col("user_id") % 7 != 0).alias("is_worker"),
        F.col("value").alias("load"),
    )


def flagged_messages(rows: DataFrame) -> DataFrame:
    """Messages with seven attempts at a time per job and a flag that is off now and then."""
    ts = to_millis(F.col("ts"))
    return rows.select(
        arrival().alias("arr"),
        job_id().alias("job_id"),
        F.concat(F.lit("b"), (F.col("event_id") * 31 % 7).cast("string")).alias("attempt_id"),
        F.col("user_id").cast("string").alias("container"),
        (F.col("event_id") % 4 != 1).alias("enabled"),
        ts.alias("ts"),
        (F.col("user_id") % 7 != 0).alias("is_worker"),
        F.col("value").alias("load"),
    )


def crowded_messages(rows: DataFrame) -> DataFrame:
    """Messages of jobs with more attempts at a time than are kept; a third is of one job."""
    ts = to_millis(F.col("ts"))
    return rows.select(
        arrival().alias("arr"),
        F.when(F.col("event_id") % 3 == 0, "hot").otherwise(job_id()).alias("job_id"),
        F.concat(F.lit("c"), (F.col("event_id") * 31 % 7).cast("string")).alias("attempt_id"),
        F.col("user_id").cast("string").alias("container"),
        (F.col("event_id") % 16 != 1).alias("enabled"),
        ts.alias("ts"),
        (F.col("user_id") % 7 != 0).alias("is_worker"),
        F.col("value").alias("load"),
    )


def job_config(rows: DataFrame) -> DataFrame:
    """Sizes of the jobs; those of event type ``view`` are left to the default."""
    n = F.col("user_id") % 20
    return (
        rows.filter(F.col("event_type") != "view")
        .select(
            job_id().alias("job_id"),
            (1024 * (1 + n % 4)).cast("int").alias("container_mb"),
            F.lit(60).alias("container_num_cores"),
            (1 + n % 3).cast("int").alias("container_count"),
        )
        .distinct()
    )


def job_config_history(rows: DataFrame) -> DataFrame:
    """Sizes of jobs from some day on; several are from the same day, many jobs have none for long."""
    n, ts = F.col("event_id"), to_millis(F.col("ts"))
    return rows.filter((F.col("event_type") != "view") & (n % 5 == 0)).select(
        job_id().alias("job_id"),
        (ts - ts % DAY_MS).alias("valid_from"),
        n.alias("seq"),
        (1024 * (1 + n % 4)).cast("int").alias("container_mb"),
        (60 + n % 7).cast("int").alias("container_num_cores"),
        (1 + n % 3).cast("int").alias("container_count"),
    )


def capacity(rows: DataFrame) -> DataFrame:
    """Free resources of the jobs of type ``click`` and ``error``; others are unlimited."""
    n = F.col("user_id") % 20
    return (
        rows.filter(F.col("event_type").isin("click", "error"))
        .select(
            job_id().alias("job_id"),
            (n * 4).alias("free_cores"),
            (n * 512).alias("free_mb"),
        )
        .distinct()
    )


def sizing_actions(rows: DataFrame) -> DataFrame:
    """Every event as an action of its job; the current size is unknown for some."""
    ts = to_millis(F.col("ts"))
    known = size_struct(F.lit(1024), F.lit(60), 1 + F.col("user_id") % 3)
    target = size_struct(F.lit(1024), 40 + F.col("event_id") % 60, 1 + F.col("user_id") % 3)
    return rows.select(
        F.col("event_id").alias("seq"),
        job_id().alias("job_id"),
        attempt_id(ts).alias("attempt_id"),
        F.when(F.col("event_id") % 5 != 0, known).alias("current_size"),
        target.alias("target_size"),
        F.when(F.col("event_id") % 3 == 0, "ENQUEUED")
        .when(F.col("event_id") % 3 == 1, "ISSUED")
        .otherwise("COMPLETE")
        .alias("status"),
        F.when(F.col("event_id") % 60 >= 20, "JOB_VCORE_SCALEUP")
        .otherwise("JOB_VCORE_SCALEDOWN")
        .alias("type"),
    )


def held_actions(rows: DataFrame, current: Column) -> DataFrame:
    """Every event as an action; those that are not current are about an earlier numbering of
    the attempts, so they hold none of today's."""
    attempt = F.when(current, F.col("attempt_id")).otherwise(F.concat(F.lit("old-"), "attempt_id"))
    return sizing_actions(rows).withColumn("attempt_id", attempt)


def flat_actions(actions: DataFrame) -> DataFrame:
    """Actions with their sizes as plain columns; an unknown current size reads as 0."""
    return actions.select(
        "seq",
        "job_id",
        "attempt_id",
        F.coalesce("current_size.container_num_cores", F.lit(0)).alias("current_cores"),
        F.col("target_size.container_num_cores").alias("target_cores"),
        F.col("target_size.container_count").alias("containers"),
        "status",
        "type",
    )


def flat_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals with their sizes as plain columns."""
    return proposals.select(
        "job_id",
        "attempt_id",
        "type",
        F.round("usage", 6).alias("usage"),
        F.col("current_size.container_mb").alias("container_mb"),
        F.col("current_size.container_num_cores").alias("current_cores"),
        F.col("target_size.container_num_cores").alias("target_cores"),
        F.col("target_size.container_count").alias("containers"),
    )


def registry_log(rows: DataFrame) -> DataFrame:
    """Every event as an entry of a metric registry; the scope may be empty or dirty."""
    n = F.col("user_id") % 20
    name = F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))
    scope = (
        F.when(F.col("event_id") % 29 == 0, F.lit(""))
        .when(F.col("event_id") % 31 == 0, F.lit("..."))
        .when(F.col("event_id") % 2 == 0, F.concat(F.col("event_type"), F.lit(".g-"), n % 4))
        .when(F.col("event_id") % 5 == 0, F.concat(F.col("event_type"), F.lit("..x y.")))
        .otherwise(F.col("event_type"))
    )
    return rows.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("p"), n).alias("process"),
        scope.alias("scope"),
        name.alias("name"),
        F.when(F.col("event_id") % 3 == 0, "counter")
        .when(F.col("event_id") % 3 == 1, "gauge")
        .otherwise("meter")
        .alias("kind"),
        F.col("value").alias("value"),
        F.when(F.col("event_id") % 7 < 5, "add").otherwise("remove").alias("op"),
    )


def label_log(rows: DataFrame) -> DataFrame:
    """Every event as a label of its process."""
    return rows.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("p"), F.col("user_id") % 20).alias("process"),
        F.concat(F.lit("<"), F.col("event_type"), F.lit(">")).alias("label"),
        F.when(F.col("event_type") == "view", F.lit("fixed"))
        .otherwise(F.get_json_object("props", "$.k"))
        .alias("value"),
    )


def tree_json() -> Column:
    """Metric tree of an event as JSON text.

    Workers report under ``taskmanager``; some have no CPU group, some no readable load.
    """
    reading = F.concat(F.lit('"Load":"'), F.col("value").cast("string"), F.lit('",'))
    load = (
        F.when(F.col("event_id") % 13 == 0, F.lit('"Time":"-1.0"'))
        .when(F.col("event_id") % 14 == 0, F.lit('"Load":"oops","Time":"-1.0"'))
        .otherwise(F.concat(reading, F.lit('"Time":"-1.0"')))
    )
    group = F.when(F.col("event_id") % 11 == 0, F.lit('"Heap":{"Used":"1"}')).otherwise(
        F.concat(F.lit('"CPU":{'), load, F.lit("}"))
    )
    root = F.when(F.col("user_id") % 7 != 0, "taskmanager").otherwise("jobmanager")
    return F.concat(
        F.lit('{"'), root, F.lit('":{"Status":{"JVM":{'), group, F.lit('}},"job.name":"'),
        "event_type", F.lit('"}}'),
    )


def deep_trees(rows: DataFrame) -> DataFrame:
    """Every event as a chain of groups, as deep as its number says, with a metric at its end.

    A few have 900 groups, a value of 20 000 characters, or 10 000 open braces and no end.
    """
    odd = F.col("event_id") % 500
    n = F.when(odd == 7, 900).otherwise((F.col("event_id") % 13).cast("int"))
    value = F.when(odd == 8, F.repeat(F.lit("{"), F.lit(20_000))).otherwise(F.col("event_type"))
    metric = F.concat(F.lit('{"v":"'), value, F.lit('"}'))
    tree = F.concat(F.repeat(F.lit('{"g":'), n), metric, F.repeat(F.lit("}"), n))
    endless = F.repeat(F.lit("{"), F.lit(10_000))
    return rows.select("event_id", F.when(odd == 9, endless).otherwise(tree).alias("tree"))


def broken_trees(rows: DataFrame) -> DataFrame:
    """Every event as a small tree; some are lists, cut short, name a key twice or are missing,
    and a few are nothing but 10 000 open braces."""
    whole = F.concat(F.lit('{"a":{"v":"'), F.col("event_type"), F.lit('"}}'))
    n = F.col("event_id") % 10
    tree = (
        F.when(F.col("event_id") % 500 == 9, F.repeat(F.lit("{"), F.lit(10_000)))
        .when(n == 1, F.lit("[1]"))
        .when(n == 2, F.expr("substring(event_type, 1, 4)"))
        .when(n == 3, F.substring(whole, 1, 6))
        .when(n == 4, F.lit('{"a":"1","a":"2"}'))
        .when(n != 5, whole)
    )
    return rows.select("event_id", tree.alias("tree"))


def clashing_leaves(rows: DataFrame) -> DataFrame:
    """Every event as a metric; some are named like a group that another one stands in."""
    process = F.concat(F.lit("p"), (F.col("event_id") % 500).cast("string"))
    n = F.col("event_id") % 3
    path = F.when(n == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    name = F.when(n == 0, "b").otherwise(F.concat(F.lit("m"), F.col("event_id").cast("string")))
    return rows.select(
        process.alias("process"), path.alias("path"), name.alias("name"),
        F.format_string("%09d", "event_id").alias("value"),
    )


def header_map() -> Column:
    """Label map of an event; the attempt is empty for some and the job missing for some."""
    attempt = F.when(F.col("event_id") % 19 == 0, F.lit("")).otherwise(
        attempt_id(to_millis(F.col("ts")))
    )
    labels = F.create_map(
        F.lit("<job_name>"), job_id(), F.lit("<job_id>"), attempt,
        F.lit("<tm_id>"), F.col("user_id").cast("string"),
    )
    return F.when(
        F.col("event_id") % 23 == 0, F.map_filter(labels, lambda k, _: k != "<job_name>")
    ).otherwise(labels)


def envelopes(rows: DataFrame) -> DataFrame:
    """Events as diagnostics envelopes with an arrival number."""
    return rows.select(
        "event_id",
        arrival().alias("arr"),
        header_map().alias("metricHeader"),
        tree_json().alias("metricsSnapshot"),
        F.lit(True).alias("autoScalingEnabled"),
        to_millis(F.col("ts")).alias("timestamp"),
    )
