"""From decoded diagnostics envelopes to message rows, with a reject side."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.rows import compute_once
from paceline.functions.text import is_blank, label

# Label names of the header and the place of the CPU load in the tree.
JOB_LABEL = "<job_name>"
ATTEMPT_LABEL = "<job_id>"
CONTAINER_LABEL = "<tm_id>"
WORKER_GROUP = "$.taskmanager"
CPU_GROUP = "$.taskmanager.Status.JVM.CPU"
LOAD_NAME = "Load"


def project_header(envelopes: DataFrame) -> DataFrame:
    """Read the three key columns out of the label map ``metricHeader``."""
    header = F.col("metricHeader")
    return envelopes.withColumns(
        {
            "job_id": label(header, JOB_LABEL),
            "attempt_id": label(header, ATTEMPT_LABEL),
            "container": label(header, CONTAINER_LABEL),
        }
    )


def sub_group(tree: Column, path: str) -> Column:
    """Sub-tree at a path as a variant; null when the path is not there."""
    return F.try_variant_get(tree, path, "variant")


def read_load(tree: Column, *, skip_missing: bool = False) -> Column:
    """CPU load of a worker snapshot as a double.

    A missing CPU group reads as 0.0 (or null with ``skip_missing``). A group without a
    readable load gives null, which :func:`reject_reason` reports.
    """
    group = sub_group(tree, CPU_GROUP)
    load = F.try_variant_get(group, f"$.{LOAD_NAME}", "string").try_cast("double")
    missing = F.lit(None).cast("double") if skip_missing else F.lit(0.0)
    absent = group.isNull() | F.is_variant_null(group)
    return F.when(absent, missing).otherwise(load)


def parse_messages(envelopes: DataFrame, *, skip_missing: bool = False) -> DataFrame:
    """Envelopes with an arrival number ``arr`` → message rows plus ``reason``.

    ``metricsSnapshot`` is the metric tree as a variant. ``reason`` is null for a usable
    row; :func:`split_rejects` uses it.
    """
    used = {"arr", "metricHeader", "metricsSnapshot", "autoScalingEnabled", "timestamp"}
    extra = [c for c in envelopes.columns if c not in used]
    tree = F.col("metricsSnapshot")
    is_worker = sub_group(tree, WORKER_GROUP).isNotNull()
    rows = project_header(envelopes).withColumn("_worker", is_worker)
    load = F.when(F.col("_worker"), read_load(tree, skip_missing=skip_missing))
    fields = F.struct(
        "job_id",
        "attempt_id",
        "container",
        F.coalesce("autoScalingEnabled", F.lit(False)),
        "timestamp",
        "_worker",
        load,
        F.col("metricHeader").isNull() | F.col("timestamp").isNull(),
    )
    names = ["job_id", "attempt_id", "container", "enabled", "ts", "is_worker", "load"]
    parsed = compute_once(rows, fields, [*names, "_malformed"], ["arr", *extra])
    return parsed.withColumn("reason", reject_reason(skip_missing)).drop("_malformed")


def reject_reason(skip_missing: bool = False) -> Column:
    """Why a parsed row cannot be used; null for a usable row."""
    bad_load = F.lit(False) if skip_missing else F.col("load").isNull()
    return (
        F.when(F.col("_malformed"), "malformed")
        .when(F.col("job_id").isNull(), "no job id")
        .when(is_blank(F.col("attempt_id")), "no attempt id")
        .when(F.col("is_worker") & bad_load, "unreadable load")
    )


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows without ``reason``, rejected rows with it)."""
    good = parsed.filter(F.col("reason").isNull()).drop("reason")
    return good, parsed.filter(F.col("reason").isNotNull())


def with_attempt(messages: DataFrame) -> DataFrame:
    """Drop rows that name no job or no attempt."""
    return messages.filter(F.col("job_id").isNotNull() & ~is_blank(F.col("attempt_id")))
