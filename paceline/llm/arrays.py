"""Arrays of any length in column functions: steps in slices, so that no fold copies a long array."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a slice; even.
SLICE = 512


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once, not anew for each element of an array."""
    return F.element_at(F.transform(F.array(value), then), 1)


def slices(size: Column, step: int = SLICE) -> Column:
    """Numbers of the slices of an array, from 0; none of an empty one."""
    last = F.floor((size - 1) / step).cast("int")
    return F.when(size > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def starts(lengths: Column) -> Column:
    """The sum of all lengths before each one, an array of integers."""

    def running(values: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            values,
            start,
            lambda acc, n: F.struct(
                (acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def of(values: Column) -> Column:
        parts = F.transform(slices(F.size(values)), lambda k: F.slice(values, k * SLICE + 1, SLICE))
        return once(
            parts,
            lambda parts: F.flatten(
                F.zip_with(
                    parts,
                    running(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, n: a + n)), F.lit(0)),
                    lambda part, first: running(part, first),
                )
            ),
        )

    return once(lengths, of)
