"""Logs of a metric registry → the snapshot message of every process."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.text import has_scope, scope_path
from paceline.operators.tree import build_tree

# Fixed value: the metric kinds a snapshot carries.
SNAPSHOT_KINDS = ("counter", "gauge")


def split_scopes(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a ``path``, rows whose scope names no group)."""
    named = has_scope(F.col("scope"))
    usable = log.filter(named).withColumn("path", scope_path(F.col("scope")))
    return usable, log.filter(~named)


def snapshot_kinds(log: DataFrame) -> DataFrame:
    """Keep the metric kinds a snapshot carries, values as text."""
    return log.filter(F.col("kind").isin(*SNAPSHOT_KINDS)).withColumn(
        "value", F.col("value").cast("string")
    )


def current_metrics(log: DataFrame, keys: list[str]) -> DataFrame:
    """Add / remove log → the metrics that are registered at its end.

    The last entry of a metric decides. Its number comes from a hash aggregate that is
    combined before the shuffle, and picks the entry afterwards.
    """
    metric = [*keys, "path", "name"]
    last = log.groupBy(*metric).agg(F.max("seq").alias("seq"))
    present = log.filter(F.col("op") == "add").join(last, [*metric, "seq"], "left_semi")
    return present.select(*metric, "kind", "value")


def known_groups(log: DataFrame, keys: list[str]) -> DataFrame:
    """Every group the log names. A group outlives its metrics, as an empty object."""
    none = F.lit(None).cast("string")
    groups = log.select(*keys, "path").distinct()
    return groups.withColumns({"name": none, "value": none})


def first_labels(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, label) the value that came first, and whether another one came later."""
    return labels.groupBy(*keys, "label").agg(
        F.min_by("value", "seq").alias("value"),
        (F.min("value") != F.max("value")).alias("conflict"),
    )


def header_map(labels: DataFrame, keys: list[str]) -> DataFrame:
    """One label map per key, entries in label order."""
    entry = F.struct("label", "value")
    merged = first_labels(labels, keys).groupBy(*keys)
    return merged.agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metricHeader")
    )


def snapshot_messages(
    log: DataFrame, labels: DataFrame, keys: list[str], timestamp_ms: Column
) -> DataFrame:
    """Registry and label logs → one snapshot envelope per key.

    A process without labels gets an empty header, one without metrics an empty tree.
    The scaling flag of a snapshot is always set.
    """
    usable, _ = split_scopes(log)
    leaves = snapshot_kinds(current_metrics(usable, keys)).drop("kind")
    trees = build_tree(leaves.unionByName(known_groups(usable, keys)), keys, "metricsSnapshot")
    rows = trees.join(header_map(labels, keys), keys, "full")
    empty = F.create_map().cast("map<string,string>")
    return rows.select(
        *keys,
        F.coalesce("metricHeader", empty).alias("metricHeader"),
        F.coalesce("metricsSnapshot", F.lit("{}")).alias("metricsSnapshot"),
        F.lit(True).alias("autoScalingEnabled"),
        timestamp_ms.cast("bigint").alias("timestamp"),
    )
