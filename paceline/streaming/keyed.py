"""The scaler on keyed operator state: one entry a job in a state store, evaluated by timers.

Where :class:`paceline.streaming.scaler.Scaler` writes its state as tables in every step, this
operator touches only the jobs that sent something, or whose timer is due. A job's messages of one
micro-batch are folded in one task, with its attempts in memory: bound the batches at the source,
and take the table form where one job sends more than a task can read.
"""

import math
import sys
import time
from collections import OrderedDict
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from paceline.functions.sizes import size_struct
from paceline.functions.times import bucket_start
from paceline.operators.buckets import dedupe_deliveries
from paceline.operators.ingest import with_attempt
from paceline.operators.state import with_size
from paceline.plans.cycle import issue_round, queue_round
from paceline.plans.evaluate import candidates, decide
from paceline.schemas import JOB_SIZE
from paceline.session import saved, saving_to
from paceline.streaming.scaler import Scaler

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIZE = [f.name for f in JOB_SIZE.fields]
#: What a job tells when it is evaluated: its latest attempt, the attempt's points, and the last
#: event time of all its attempts.
TOLD = (
    "job_id string, attempt_id string, life long, created long, last_arr long, first_time long,"
    " last_time long, container_mb int, container_num_cores int, container_count int,"
    " clock long, buckets array<long>, loads array<double>"
)
FIELDS = ("created", "last_arr", "first_time", "last_time", *SIZE)


class Jobs(StatefulProcessor):
    """Attempts and metric points of a job. With ``interval_ms`` a job tells of itself whenever its
    timer fires, which its first message starts; without, after each batch that has messages of it."""

    def __init__(self, max_attempts: int, retention_ms: int, interval_ms: int | None):
        self.max_attempts, self.retention_ms, self.interval_ms = max_attempts, retention_ms, interval_ms

    def init(self, handle) -> None:
        self.handle = handle
        sizes = ", ".join(f"{n} int" for n in SIZE)
        self.attempts = handle.getMapState(
            "attempts", "attempt_id string", f"created long, last_arr long, first_time long, last_time long, {sizes}"
        )
        self.points = handle.getMapState(
            "points", "attempt_id string", "buckets array<long>, loads array<double>"
        )

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        known = self.read()
        before = {a: dict(v) for a, v in known.items()}
        parts = list(rows)
        batch = pd.concat(parts).sort_values("arr") if len(parts) > 1 else parts[0].sort_values("arr")
        points = self.fold(known, batch)
        self.write(before, known, points)
        if self.interval_ms is None:
            yield from self.told(key[0], known)
        elif not list(self.handle.listTimers()):
            self.wait(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = self.read()
        if known:
            self.wait(timerValues)
        yield from self.told(key[0], known)

    def wait(self, timerValues) -> None:
        """Until the next whole interval, so that all jobs are evaluated in the same round."""
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer((now // self.interval_ms + 1) * self.interval_ms)

    def read(self) -> OrderedDict:
        """Known attempts, oldest first."""
        found = [(k[0], dict(zip(FIELDS, v, strict=True))) for k, v in self.attempts.iterator()]
        return OrderedDict(sorted(found, key=lambda x: x[1]["created"]))

    def fold(self, known: OrderedDict, batch: pd.DataFrame) -> dict:
        """Read the messages in order; returns the changed points by attempt, None for those begun anew."""
        points: dict = {}
        columns = ["arr", "attempt_id", "enabled", "ts", "bucket", "counts", "load", *SIZE]
        for arr, attempt, enabled, ts, bucket, counts, load, *size in zip(
            *(batch[c].tolist() for c in columns), strict=True
        ):
            state = known.get(attempt)
            if state is None:
                if not enabled:
                    known.clear()
                    points.clear()
                    continue
                values = (arr, arr, ts, ts, *map(int, size))
                state = known[attempt] = dict(zip(FIELDS, values, strict=True))
                points[attempt] = {}
                if len(known) > self.max_attempts:
                    points.pop(known.popitem(last=False)[0], None)
            state["last_arr"] = arr
            if ts < state["last_time"]:
                continue
            state["last_time"] = ts
            if counts:
                if attempt not in points:
                    points[attempt] = self.points_of(attempt)
                own = points[attempt]
                old = own.get(bucket, -math.inf)
                own[bucket] = load if math.isnan(load) or load > old else old
        return points

    def points_of(self, attempt: str) -> dict:
        found = self.points.getValue((attempt,)) if self.points.containsKey((attempt,)) else None
        return dict(zip(found[0], found[1], strict=True)) if found else {}

    def write(self, before: dict, known: OrderedDict, points: dict) -> None:
        for attempt, state in before.items():
            gone = attempt not in known
            if gone:
                self.attempts.removeKey((attempt,))
            if (gone or known[attempt]["created"] != state["created"]) and self.points.containsKey((attempt,)):
                self.points.removeKey((attempt,))
        for attempt, state in known.items():
            if state != before.get(attempt):
                self.attempts.updateValue((attempt,), tuple(state[f] for f in FIELDS))
        for attempt, own in points.items():
            if own and attempt in known:
                newest = max(own)
                kept = sorted(b for b in own if newest - b <= self.retention_ms)
                self.points.updateValue((attempt,), (kept, [own[b] for b in kept]))

    def told(self, job: str, known: OrderedDict):
        if not known:
            return
        attempt, state = max(known.items(), key=lambda x: x[1]["created"])
        points = self.points_of(attempt)
        buckets = sorted(points)
        row = {
            "job_id": job,
            "attempt_id": attempt,
            "life": state["created"],
            **state,
            "clock": max(s["last_time"] for s in known.values()),
            "buckets": buckets,
            "loads": [points[b] for b in buckets],
        }
        yield pd.DataFrame({k: [v] for k, v in row.items()})


@dataclass
class KeyedScaler(Scaler):
    """The rounds of a :class:`Scaler` over what jobs tell.

    With ``interval_ms`` jobs are evaluated by their timers, also while no input comes, and heads of
    the queue that were held back are tried again in every round; without, after every batch that
    has messages of them. The size of a deployment is what ``job_config``, a table, says when it is
    first seen. ``now_ms`` is a number, or None for the time of the round; ``event_time`` takes the
    last event time of all jobs that have told something. ``heard`` counts rounds in which any did.
    """

    interval_ms: int | None = None
    event_time: bool = False
    heard: int = 0

    def told(self, messages: DataFrame) -> DataFrame:
        """What the jobs of a stream of messages tell."""
        settings = self.settings
        counts = F.coalesce(F.col("is_worker"), F.lit(False)) & F.col("load").isNotNull()
        rows = with_size(with_attempt(messages), self.job_config, settings.default_size).select(
            "job_id",
            "attempt_id",
            "arr",
            F.coalesce("enabled", F.lit(False)).alias("enabled"),
            "ts",
            bucket_start(F.col("ts"), settings.granularity_ms).alias("bucket"),
            counts.alias("counts"),
            F.coalesce("load", F.lit(0.0)).alias("load"),
            *(F.col("size")[n].alias(n) for n in SIZE),
        )
        jobs = Jobs(settings.max_attempts, settings.retention_ms, self.interval_ms)
        mode = "none" if self.interval_ms is None else "processingTime"
        return (
            rows.where("job_id is not null")
            .groupBy("job_id")
            .transformWithStateInPandas(jobs, TOLD, "Update", mode)
        )

    def step(self, told: DataFrame, step: int) -> None:
        with saving_to(self.tables.scratch(step)):
            told = saved(told)
            spark = told.sparkSession
            latest = told.drop("buckets", "loads").withColumn("size", size_struct(*map(F.col, SIZE)))
            points = told.select(
                "job_id", "attempt_id", "life", F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("loads").alias("v")))
            )
            clock = self.tables.clock(spark, step - 1).unionByName(told.select("clock"))
            clock = self.tables.keep_clock(clock.agg(F.max("clock").alias("clock")), step)
            now = self.now_ms if self.now_ms is not None else int(time.time() * 1000)
            now = clock.first()["clock"] or 0 if self.event_time else now
            queue = self.tables.read(spark, "actions", step - 1)
            proposals = decide(candidates(latest, self.settings, now, queue), points, self.settings)
            queue = queue_round(queue, proposals, step, self.settings)
            enforce = self.enforce(step) if self.enforce else None
            queue, _ = issue_round(queue, self.capacity, enforce)
            self.tables.write(queue, "actions", step)
            self.last_step, self.heard = step, self.heard + (not told.isEmpty())

    def start(
        self,
        messages: DataFrame,
        checkpoint: str,
        *,
        trigger: dict,
        ids: list[str] | None = None,
        watermark: str = "10 minutes",
    ) -> StreamingQuery:
        """As :meth:`Scaler.start`; the session gets the state store that this operator needs."""
        messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
        if ids:
            messages = dedupe_deliveries(messages, ids, watermark)
        writer = self.told(messages).writeStream.outputMode("update").foreachBatch(self.step)
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def kept_attempts(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The attempts that a :class:`KeyedScaler` has in its state store, after its last batch or a given one.

    Reads the checkpoint of a running or ended query, which is not disturbed by it.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    reader = spark.read.format("statestore").option("stateVarName", "attempts")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(checkpoint).select(
        F.col("key")["job_id"].alias("job_id"),
        F.col("user_map_key")["attempt_id"].alias("attempt_id"),
        *(F.col("user_map_value")[f].alias(f) for f in FIELDS[:4]),
        size_struct(*(F.col("user_map_value")[n] for n in SIZE)).alias("size"),
    )
