"""Which messages count, and for which life of a deployment.

Messages of a job are read in order of arrival:

* an unknown attempt becomes known by an *enabled* message;
* a *disabled* message of an unknown attempt forgets every attempt of the job (a reset);
* a message of a known attempt counts unless its event time went back;
* a job keeps at most ``max_attempts`` attempts, the oldest known one is forgotten first.

A forgotten attempt may become known again later. Each such life has its own number, the
column ``life``: unique per life within (job, attempt).

Most jobs never send a disabled message and have no more attempts than are kept, so one cheap
profile pass finds the jobs that do, and only those take the longer ways.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.arrival import CHUNK, chunk_of, gate, running
from paceline.operators.ingest import with_attempt
from paceline.operators.replay import replayed
from paceline.session import saved

MAX_ATTEMPTS = 100

ATTEMPT = ["job_id", "attempt_id"]
LIFE = ["job_id", "attempt_id", "life"]

# `life` of attempts in a job that was never reset; below every arrival number.
NO_RESET = -(2**62)
# Stands for "no enabled message so far"; below NO_RESET, so it reads as unknown.
NEVER = NO_RESET - 1


def state_columns() -> list[Column]:
    """What is remembered of a life: the arrivals and event times of its first and last
    message, and the latest event time among its metric messages."""
    metric_time = F.when(F.col("is_worker") & F.col("load").isNotNull(), F.col("ts"))
    return [
        F.min("arr").alias("created"),
        F.max("arr").alias("last_arr"),
        F.min_by("ts", "arr").alias("first_time"),
        F.max("ts").alias("last_time"),
        F.max(metric_time).alias("last_metric"),
    ]


@dataclass(frozen=True)
class Lives:
    """``rows``: messages of known attempts with ``life`` and ``live`` (still known at the
    end), before the event-time gate. ``state``: one row per live life."""

    rows: DataFrame
    state: DataFrame


def read_lives(
    messages: DataFrame, *, max_attempts: int = MAX_ATTEMPTS, chunk: int = CHUNK
) -> Lives:
    """Find the lives of all attempts.

    Runs one pass over the messages right away: a profile per (job, attempt), combined
    before the shuffle. It shows which jobs are unusual, and it is the state of all
    others. First, last and creation of a life are the same before and after the gate, so
    the state needs no ordering work.
    """
    rows = with_attempt(messages)
    off = F.max(~F.col("enabled")).alias("_off")
    profile = saved(rows.groupBy(*ATTEMPT).agg(off, *state_columns()))
    jobs = profile.groupBy("job_id").agg(
        F.max("_off").alias("flagged"), (F.count(F.lit(1)) > max_attempts).alias("crowded")
    )
    unusual = jobs.filter("flagged or crowded")
    usual = {"life": F.lit(NO_RESET), "live": F.lit(True)}
    state = profile.drop("_off").withColumn("life", F.lit(NO_RESET))
    if unusual.isEmpty():
        return Lives(rows.withColumns(usual), state)

    unusual = saved(unusual)
    told = _unusual_lives(rows.join(unusual, "job_id", "left_semi"), unusual, max_attempts, chunk)
    return Lives(
        rows.join(unusual, "job_id", "left_anti").withColumns(usual).unionByName(told),
        state.join(unusual, "job_id", "left_anti").unionByName(summarise(told)),
    )


def with_lives(messages: DataFrame, **options) -> DataFrame:
    """The rows of :func:`read_lives`."""
    return read_lives(messages, **options).rows


def fold(
    messages: DataFrame, *, max_attempts: int = MAX_ATTEMPTS, chunk: int = CHUNK
) -> DataFrame:
    """Messages that count, with ``life`` and ``live``."""
    return gate(with_lives(messages, max_attempts=max_attempts, chunk=chunk), LIFE, chunk=chunk)


def summarise(rows: DataFrame) -> DataFrame:
    """Rows with lives → one state row per live life."""
    return rows.filter("live").groupBy(*LIFE).agg(*state_columns())


def _unusual_lives(
    rows: DataFrame, jobs: DataFrame, max_attempts: int, chunk: int
) -> DataFrame:
    crowded = jobs.filter("crowded").select("job_id")
    told = _split_by_resets(rows.join(crowded, "job_id", "left_anti"), chunk)
    if crowded.isEmpty():
        return told
    return told.unionByName(_follow(rows.join(crowded, "job_id", "left_semi"), max_attempts, chunk))


# --- resets ------------------------------------------------------------------------
#
# A disabled message resets its job when its attempt has had no enabled message since the
# last reset. With `known` = arrival of the attempt's last enabled message, that reads
# `known < last reset`. So all that a job carries along its disabled messages is one
# number, the last reset. As `known` is below the message's own arrival, every start above
# the lowest `known` of a span of messages leads to the same end, and any other start stays
# as it is: a span is a pair (lowest known, end), and so are spans of spans. Spans of a
# bounded number of messages are folded apart from each other, joined up over their pairs,
# and replayed apart from each other, all in arrays of bounded size.


def _split_by_resets(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows with ``life`` = the last reset before them; reset messages are dropped."""
    seen = running(rows, ATTEMPT, F.when(F.col("enabled"), F.col("arr")), "_known", chunk=chunk)
    off = seen.filter(~F.col("enabled")).select(
        "job_id", "arr", F.coalesce("_known", F.lit(NEVER)).alias("_known")
    )
    resets = saved(_find_resets(saved(off), chunk))

    # A mark goes right before the message that resets, so that message finds itself.
    marks = resets.select("job_id", "arr", (F.col("arr") * 2).alias("_place"))
    placed = rows.withColumn("_place", F.col("arr") * 2 + 1)
    both = placed.withColumn("_mark", F.lit(False)).unionByName(
        marks.withColumn("_mark", F.lit(True)), allowMissingColumns=True
    )
    mark = F.when(F.col("_mark"), F.col("arr"))
    timed = running(both, ["job_id"], mark, "life", arr="_place", chunk=2 * chunk)
    timed = timed.filter(~F.col("_mark")).withColumn("life", F.coalesce("life", F.lit(NO_RESET)))
    last = resets.groupBy("job_id").agg(F.max("arr").alias("_last"))
    kept = timed.filter(F.col("life") != F.col("arr")).join(last, "job_id", "left")
    live = F.col("life") == F.coalesce("_last", F.lit(NO_RESET))
    return kept.withColumn("live", live).select(*rows.columns, "life", "live")


SPAN, SPANS = 1 << 12, 1 << 10  # arrival numbers of a span, spans of a span of spans
ENDLESS = 2**62  # a start above every arrival number


def _after(spans: Column, start: Column) -> Column:
    """The last reset after consecutive spans (low, end), given the one before them."""
    return F.aggregate(
        spans, start, lambda last, s: F.when(last > s["low"], s["end"]).otherwise(last)
    )


def _starts(spans: Column, start: Column, number: str) -> Column:
    """The last reset before each of some consecutive spans, as (number, start)."""
    none = F.array().cast(f"array<struct<{number}:bigint,start:bigint>>")
    return F.aggregate(
        spans,
        F.struct(start.alias("last"), none.alias("starts")),
        lambda acc, s: F.struct(
            F.when(acc["last"] > s["low"], s["end"]).otherwise(acc["last"]).alias("last"),
            F.concat(
                acc["starts"], F.array(F.struct(s[number].alias(number), acc["last"].alias("start")))
            ).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )


def _find_resets(off: DataFrame, chunk: int) -> DataFrame:
    """Disabled messages (job_id, arr, _known) → those that reset their job."""
    width = min(SPAN, chunk)
    start = F.lit(ENDLESS).cast("bigint")
    message = F.struct("arr", F.col("_known").alias("low"), F.col("arr").alias("end"))
    spans = saved(
        off.groupBy("job_id", chunk_of("arr", width).alias("span"))
        .agg(F.array_sort(F.collect_list(message)).alias("rows"))
        .withColumn("low", F.array_min(F.transform("rows", lambda r: r["low"])))
        .withColumn("end", _after(F.col("rows"), start))
    )
    parts = (
        spans.groupBy("job_id", F.expr(f"span div {SPANS}").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("span", "low", "end"))).alias("spans"))
        .withColumn("low", F.array_min(F.transform("spans", lambda s: s["low"])))
        .withColumn("end", _after(F.col("spans"), start))
    )
    first = F.lit(NO_RESET).cast("bigint")
    jobs = (
        parts.groupBy("job_id")
        .agg(F.array_sort(F.collect_list(F.struct("part", "low", "end"))).alias("parts"))
        .select("job_id", F.inline(_starts(F.col("parts"), first, "part")))
    )
    begun = parts.join(jobs, ["job_id", "part"]).select(
        "job_id", F.inline(_starts(F.col("spans"), F.col("start"), "span"))
    )
    none = F.array().cast("array<bigint>")
    found = F.aggregate(
        "rows",
        F.struct(F.col("start").alias("last"), none.alias("found")),
        lambda acc, r: F.struct(
            F.when(acc["last"] > r["low"], r["end"]).otherwise(acc["last"]).alias("last"),
            F.when(acc["last"] > r["low"], F.concat(acc["found"], F.array(r["end"])))
            .otherwise(acc["found"])
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return spans.join(begun, ["job_id", "span"]).select("job_id", F.explode(found).alias("arr"))


# --- eviction ----------------------------------------------------------------------
#
# Jobs with more attempts than are kept. The replay tells which messages made an attempt known and which ones emptied the queue.
# Every message of an unknown attempt is one of these, so the last such message of its own
# attempt tells each other one its life.


def _follow(rows: DataFrame, max_attempts: int, chunk: int) -> DataFrame:
    replays = replayed(rows, max_attempts)
    changes = replays.select("job_id", F.inline("changes"))
    # A mark goes right before its message, so that message finds itself.
    marks = changes.select(
        *ATTEMPT,
        (F.col("arr") * 2).alias("_place"),
        (F.col("arr") * 2 + F.col("enabled").cast("int")).alias("_mark"),
    )
    both = rows.withColumn("_place", F.col("arr") * 2 + 1).unionByName(
        marks, allowMissingColumns=True
    )
    told = running(both, ATTEMPT, F.col("_mark"), "_change", arr="_place", chunk=2 * chunk)
    born = told.filter(F.col("_mark").isNull() & (F.col("_change") % 2 == 1))
    born = born.withColumn("life", F.expr("_change div 2"))

    last = replays.groupBy("job_id").agg(F.max("chunk").alias("chunk"))
    known = replays.join(last, ["job_id", "chunk"], "left_semi").select(
        "job_id", F.explode("queue").alias("attempt_id")
    )
    births = changes.filter("enabled").groupBy(*ATTEMPT).agg(F.max("arr").alias("life"))
    alive = births.join(known, ATTEMPT, "left_semi").withColumn("live", F.lit(True))
    told = born.join(alive, LIFE, "left").select(
        *rows.columns, "life", F.coalesce("live", F.lit(False)).alias("live")
    )
    return saved(told)  # the gate and the state both start from here
