"""Helpers that work on whole rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(rows: DataFrame, fields: Column, names: list[str], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the fields of a struct under ``names``.

    A filter on a projected column is pushed below the projection together with a copy of
    its expression, once per use; parsing is too costly for that. A generator over a single
    value gives the same row but holds such filters back.
    """
    return rows.select(*keep, F.inline(F.array(fields)).alias(*names))
