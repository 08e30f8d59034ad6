"""Session preparation, and tables that cut lineage."""

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession

_place: ContextVar[tuple[str, Iterator[int]] | None] = ContextVar("place", default=None)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone: every epoch-millis column in this package means UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A session without executors of its own (master ``local``) may leave it unset and gets a
    new local folder for the rest of the session. On a cluster that raises: each executor
    would write to its own disk, and rows would be lost.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir():
        return context.getCheckpointDir().rpartition("/")[0]
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="paceline-"))
    return context.getCheckpointDir().rpartition("/")[0]


def saved(rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them back.

    Cuts the lineage at something that survives the loss of executors. Unlike after a
    checkpoint, the planner knows the true size of what it reads, so it broadcasts the
    table only when it is small.
    """
    path = _new_path(rows.sparkSession)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _new_path(spark: SparkSession) -> str:
    place = _place.get()
    return f"{place[0]}/{next(place[1])}" if place else f"{run_dir(spark)}/rows"


def rounds(
    rows: DataFrame, advance: Callable[[DataFrame], DataFrame], unfinished: Column
) -> DataFrame:
    """Rows in which ``unfinished`` does not hold, after the others went through ``advance`` until none is left.

    Each round is written below one path and starts from what the one before wrote, so its plan
    is that of a single step; the result is one scan of all rounds.
    """
    spark, schema, folder, paths = rows.sparkSession, rows.schema, _new_path(rows.sparkSession), []
    while True:
        paths.append(f"{folder}/{len(paths)}")
        rows.write.mode("overwrite").parquet(paths[-1])
        rest = spark.read.schema(schema).parquet(paths[-1]).where(unfinished)
        if rest.isEmpty():
            return spark.read.schema(schema).parquet(*paths).where(~unfinished)
        rows = advance(rest)


@contextmanager
def saving_to(folder: str) -> Iterator[None]:
    """Let :func:`saved` write below this folder, over what an earlier run left there."""
    token = _place.set((folder, count()))
    try:
        yield
    finally:
        _place.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """One folder for all tables that are saved inside, removed at the end.

    Results read from those tables, so write or collect them before the block ends.
    """
    folder = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    try:
        with saving_to(folder):
            yield folder
    finally:
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def session_dir(spark: SparkSession) -> str:
    """The folder of this application below the shared one."""
    return f"{shared_dir(spark)}/paceline-{spark.sparkContext.applicationId}"


def run_dir(spark: SparkSession) -> str:
    """A new folder below that of the application."""
    return f"{session_dir(spark)}/{uuid.uuid4().hex}"
