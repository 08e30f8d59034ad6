"""The scaler on a stream: state as tables, one step per micro-batch.

What a deployment's past means for its future fits into two messages (its first and its
last one) and the retained metric points. So a step puts the remembered messages in front
of the new ones and runs the batch operators on both. That splits a hot job over many
tasks like any batch does, where state inside one operator would hold it in one task.

Each step reads the tables of the step before and writes its own, in a ring of slots. A
step that is run again after a failure finds its input unchanged and writes the same.
"""

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paceline.operators.arrival import gate
from paceline.operators.buckets import bucket, dedupe_deliveries, retained
from paceline.operators.fold import LIFE, read_lives
from paceline.operators.state import latest_attempts, with_size
from paceline.plans.cycle import Enforcer, Fresh, issue_round, now_read, queue_round
from paceline.plans.evaluate import Now, candidates, decide
from paceline.plans.policies import Settings
from paceline.schemas import JOB_SIZE, SIZING_ACTIONS
from paceline.session import saved, saving_to

# `life` of a remembered attempt is the arrival number of its first message.
ATTEMPTS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("attempt_id", T.StringType()),
        T.StructField("life", T.LongType()),
        T.StructField("created", T.LongType()),
        T.StructField("last_arr", T.LongType()),
        T.StructField("first_time", T.LongType()),
        T.StructField("last_time", T.LongType()),
        T.StructField("size", JOB_SIZE),
    ]
)
POINTS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("attempt_id", T.StringType()),
        T.StructField("life", T.LongType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("v", T.DoubleType()),
    ]
)
TABLES = {"attempts": ATTEMPTS, "points": POINTS, "actions": SIZING_ACTIONS}


@dataclass(frozen=True)
class StateTables:
    """Tables of the last few steps below one folder that all executors can reach."""

    root: str
    slots: int = 8

    def _path(self, name: str, step: int) -> str:
        return f"{self.root}/{name}/slot={step % self.slots}"

    def scratch(self, step: int) -> str:
        """Folder for intermediate tables of a step; used again when the ring comes round."""
        return self._path("scratch", step)

    def read(self, spark: SparkSession, name: str, step: int) -> DataFrame:
        """Table after a step; before the first step it is empty."""
        if step < 0:
            return spark.createDataFrame([], TABLES[name])
        return spark.read.schema(TABLES[name]).parquet(self._path(name, step))

    def clock(self, spark: SparkSession, step: int) -> DataFrame:
        """The last event time that was known after a step, in one row; before the first step none."""
        if step < 0:
            return spark.createDataFrame([], "clock bigint")
        return spark.read.schema("clock bigint").parquet(self._path("clock", step))

    def keep_clock(self, rows: DataFrame, step: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._path("clock", step))
        return self.clock(rows.sparkSession, step)

    def write(self, rows: DataFrame, name: str, step: int) -> DataFrame:
        columns = [F.col(f.name).cast(f.dataType) for f in TABLES[name].fields]
        rows.select(*columns).write.mode("overwrite").parquet(self._path(name, step))
        return self.read(rows.sparkSession, name, step)


def remembered(attempts: DataFrame, like: DataFrame) -> DataFrame:
    """Attempts as the two messages that stand for their past, in the shape of ``like``."""
    first = F.struct(F.col("created").alias("arr"), F.col("first_time").alias("ts"))
    last = F.struct(F.col("last_arr").alias("arr"), F.col("last_time").alias("ts"))
    both = F.when(F.col("last_arr") > F.col("created"), F.array(first, last)).otherwise(
        F.array(first)
    )
    rows = attempts.select("job_id", "attempt_id", F.explode(both).alias("m"))
    return rows.select(
        F.col("m.arr").alias("arr"),
        "job_id",
        "attempt_id",
        F.lit(None).cast("string").alias("container"),
        F.lit(True).alias("enabled"),
        F.col("m.ts").alias("ts"),
        F.lit(False).alias("is_worker"),
        F.lit(None).cast("double").alias("load"),
    ).select(*like.columns)


def advance(
    before: tuple[DataFrame, DataFrame],
    batch: DataFrame,
    settings: Settings,
    write: Callable[[DataFrame, str], DataFrame],
    job_config: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(attempts, points) after a batch of messages whose arrival numbers are higher."""
    old_attempts, old_points = before
    lives = read_lives(
        remembered(old_attempts, batch).unionByName(batch),
        max_attempts=settings.max_attempts,
        chunk=settings.chunk,
    )
    now = lives.state
    # The size of a deployment is the one configured when it was first seen.
    known = old_attempts.select("job_id", "attempt_id", "created", F.col("size").alias("_size"))
    sized = with_size(now, job_config, settings.default_size)
    sized = sized.join(known, ["job_id", "attempt_id", "created"], "left")
    sized = sized.withColumn("size", F.coalesce("_size", "size"))
    births = now.select(*LIFE, "created")
    attempts = write(sized.withColumn("life", F.col("created")), "attempts")

    counted = gate(lives.rows.filter("live"), LIFE, chunk=settings.chunk)
    fresh = bucket(counted, keys=LIFE, width_ms=settings.granularity_ms)
    fresh = fresh.join(births, LIFE).withColumn("life", F.col("created")).drop("created")
    kept = old_points.join(attempts.select(*LIFE), LIFE, "left_semi")
    merged = kept.unionByName(fresh).groupBy(*LIFE, "bucket").agg(F.max("v").alias("v"))
    points = write(retained(merged, settings.retention_ms, keys=LIFE), "points")
    return attempts, points


@dataclass
class Scaler:
    """A micro-batch step: remember, evaluate, queue, issue.

    Sizes and capacity that are given as functions are read anew in every step. ``enforce``
    gets the number of the step and gives the enforcer for it, so that a step that runs again
    can replace what it recorded.
    """

    tables: StateTables
    settings: Settings
    now_ms: Now | None = None
    job_config: Fresh = None
    capacity: Fresh = None
    enforce: Callable[[int], Enforcer] | None = None
    last_step: int = -1

    def step(self, batch: DataFrame, step: int) -> None:
        with saving_to(self.tables.scratch(step)):
            self._step(batch, step)

    def tick(self, spark: SparkSession) -> DataFrame:
        """A round without input, for a scheduler to call between batches: evaluates at the
        present time, and retries heads that were held back. Returns the queue, which takes the
        place of that of the last step; running it again repeats the round."""
        step = self.last_step
        with saving_to(self.tables.scratch(step) + "-tick"):
            attempts, points = (self.tables.read(spark, n, step) for n in ("attempts", "points"))
            queue = saved(self.tables.read(spark, "actions", step))
            return self._round(attempts, points, queue, step)

    def _round(
        self, attempts: DataFrame, points: DataFrame, queue: DataFrame, step: int
    ) -> DataFrame:
        now = self.now_ms if self.now_ms is not None else int(time.time() * 1000)
        now = now(attempts) if callable(now) else now
        latest = candidates(latest_attempts(attempts), self.settings, now, queue)
        proposals = decide(latest, points, self.settings)
        queue = queue_round(queue, proposals, step, self.settings)
        enforce = self.enforce(step) if self.enforce else None
        queue, _ = issue_round(queue, self.capacity, enforce)
        return self.tables.write(queue, "actions", step)

    def _step(self, batch: DataFrame, step: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            before = tuple(self.tables.read(spark, n, step - 1) for n in ("attempts", "points"))
            attempts, points = advance(
                before,
                batch,
                self.settings,
                lambda rows, name: self.tables.write(rows, name, step),
                now_read(self.job_config),
            )
            self._round(attempts, points, self.tables.read(spark, "actions", step - 1), step)
            self.last_step = step
        finally:
            batch.unpersist()

    def start(
        self,
        messages: DataFrame,
        checkpoint: str,
        *,
        trigger: dict,
        ids: list[str] | None = None,
        watermark: str = "10 minutes",
    ) -> StreamingQuery:
        """Run on a stream of message rows; ``trigger`` as for ``DataStreamWriter.trigger``.

        With ``ids``, the columns that tell a message, redelivered ones are dropped; they are
        remembered for as long as the watermark on the event time lets them come.
        """
        if ids:
            messages = dedupe_deliveries(messages, ids, watermark)
        writer = messages.writeStream.foreachBatch(self.step)
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
