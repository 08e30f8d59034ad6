"""The queue of known attempts where forgotten ones come back, replayed by guesses.

Every decision of such a job needs the queue as it is at that moment, so the job is a sequence. It
is cut into chunks of arrival numbers that are replayed apart from each other, each from a guess of
the queue it begins with. A replay lists its changes, births and resets. The short lists are
chained to new guesses: a chunk whose guess stayed hands on the queue it ended with, another one
what the guess makes of its list. Only chunks whose guess was wrong are replayed again. Once no
guess moves, the first chunk of a job began with nothing, and each other one with what the one
before it ended with, which is the sequence.

Births push older attempts out, so most wrong guesses are forgotten within a chunk, and two or three
rounds are enough. In every round at least one more chunk of each job becomes final.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.arrival import chunk_of
from paceline.session import saved

#: Arrival numbers of a chunk and of the slices it is folded in; chunks that are chained in one row.
WIDTH, SLICE, PART = 1 << 16, 1 << 9, 1 << 8
CHUNKS = ["job_id", "chunk"]

QUEUE = "array<string>"
CHANGE = "struct<arr:bigint,attempt_id:string,enabled:boolean>"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _once(value: Column, then) -> Column:
    """then of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _replayed(slices: Column, start: Column, keep: int) -> Column:
    """(queue, changes) after arrays of messages (arr, attempt_id, enabled), given the queue before.

    A message of a known attempt changes nothing. Of an unknown one, an enabled message pushes it
    behind the others and the oldest out, a disabled one empties the queue.
    """

    def step(acc: Column, message: Column) -> Column:
        queue, attempt = acc["queue"], message["attempt_id"]
        others = F.when(F.size(queue) >= keep, F.slice(queue, 2, keep - 1)).otherwise(queue)
        pushed = F.concat(others, F.array(attempt))
        changed = F.struct(
            F.when(message["enabled"], pushed).otherwise(_empty(QUEUE)).alias("queue"),
            F.concat(acc["changes"], F.array(message)).alias("changes"),
        )
        return F.when(F.array_contains(queue, attempt), acc).otherwise(changed)

    def fold(acc: Column, part: Column) -> Column:
        begun = F.struct(acc["queue"].alias("queue"), _empty(f"array<{CHANGE}>").alias("changes"))
        return _once(
            F.aggregate(part, begun, step),
            lambda end: F.struct(
                end["queue"].alias("queue"),
                F.concat(acc["changes"], F.array(end["changes"])).alias("changes"),
            ),
        )

    begun = F.struct(start.alias("queue"), _empty(f"array<array<{CHANGE}>>").alias("changes"))
    return F.aggregate(
        slices,
        begun,
        fold,
        lambda acc: F.struct(
            acc["queue"].alias("queue"), F.flatten(acc["changes"]).alias("changes")
        ),
    )


def _chunks(rows: DataFrame, width: int) -> DataFrame:
    """(job_id, chunk, slices): the messages of a chunk, in slices; of neighbours with one attempt
    and flag only the first, as the others act like it. The rows are shuffled once."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    thin = rows.select(
        "job_id", chunk_of("arr", width).alias("chunk"), "arr", "attempt_id", "enabled"
    ).repartition(parts, *CHUNKS)

    def firsts(messages: Column) -> Column:
        def first(message: Column, i: Column) -> Column:
            before = F.element_at(messages, F.greatest(i, F.lit(1)))
            same = (before["attempt_id"] == message["attempt_id"]) & (
                before["enabled"] == message["enabled"]
            )
            return (i == 0) | ~same

        return F.filter(messages, first)

    message = F.struct("arr", "attempt_id", "enabled")
    slices = thin.groupBy(*CHUNKS, chunk_of("arr", min(SLICE, width)).alias("slice")).agg(
        _once(F.array_sort(F.collect_list(message)), firsts).alias("messages")
    )
    return slices.groupBy(*CHUNKS).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("slice", "messages"))), lambda s: s["messages"]
        ).alias("slices")
    )


def _replays(chunks: DataFrame, keep: int) -> DataFrame:
    """Chunks with their ``start`` → (job_id, chunk, start, queue, changes)."""
    end = F.inline(F.array(_replayed(F.col("slices"), F.col("start"), keep)))
    return chunks.select(*CHUNKS, "start", end.alias("queue", "changes"))


def _guesses(replays: DataFrame, parts: DataFrame, keep: int) -> DataFrame:
    """(job_id, part, start, starts, queue): the chunks of a part chained, given its first queue.

    Of a long list of changes the first and the last ones tell the queue best; what they leave
    out can only spoil a guess.
    """
    changes = F.col("changes")
    few = F.when(F.size(changes) <= 2 * keep, changes).otherwise(
        F.concat(F.slice(changes, 1, keep), F.slice(changes, -keep, keep))
    )
    gathered = (
        replays.groupBy("job_id", F.expr(f"chunk div {PART}").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "start", "queue", few.alias("few")))).alias("chunks"))
        .join(parts, ["job_id", "part"], "left")
        .withColumn("start", F.coalesce("start", _empty(QUEUE)))
    )

    def step(acc: Column, chunk: Column) -> Column:
        guessed = _replayed(F.array(chunk["few"]), acc["queue"], keep)["queue"]
        return F.struct(
            F.when(acc["queue"] == chunk["start"], chunk["queue"]).otherwise(guessed).alias("queue"),
            F.concat(
                acc["starts"],
                F.array(F.struct(chunk["chunk"].alias("chunk"), acc["queue"].alias("start"))),
            ).alias("starts"),
        )

    begun = F.struct(
        F.col("start").alias("queue"),
        _empty("array<struct<chunk:bigint,start:array<string>>>").alias("starts"),
    )
    return gathered.select(
        "job_id", "part", "start", F.inline(F.array(F.aggregate("chunks", begun, step))).alias("queue", "starts")
    )


def replayed(rows: DataFrame, max_attempts: int, width: int | None = None) -> DataFrame:
    """Messages (job_id, arr, attempt_id, enabled) → (job_id, chunk, start, queue, changes).

    queue has the known attempts at the end of the chunk, oldest first; changes the messages that
    made an attempt known or, disabled ones, emptied the queue. Jobs without rows have no chunks.
    """
    chunks = saved(_chunks(rows, width or WIDTH))
    replays = saved(_replays(chunks.withColumn("start", _empty(QUEUE)), max_attempts))
    order = Window.partitionBy("job_id").orderBy("part")
    parts = replays.sparkSession.createDataFrame([], f"job_id string, part bigint, start {QUEUE}")
    while True:
        told = saved(_guesses(replays, parts, max_attempts))
        before = F.coalesce(F.lag("queue").over(order), _empty(QUEUE))
        parts = told.select("job_id", "part", before.alias("start"), F.col("start").alias("old"))
        wrong = parts.where("start != old").select("job_id").limit(1)
        parts = parts.drop("old")
        guesses = told.select("job_id", F.inline("starts"))
        old = replays.select(*CHUNKS, F.col("start").alias("old"))
        moved = saved(guesses.join(old, CHUNKS).where("start != old").drop("old"))
        if moved.isEmpty():
            if wrong.isEmpty():
                return replays
            continue
        again = _replays(chunks.join(moved, CHUNKS), max_attempts)
        replays = saved(replays.join(moved.select(CHUNKS), CHUNKS, "left_anti").unionByName(again))
