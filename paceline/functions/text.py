"""String and label functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters a scope component may keep.
SCOPE_UNSAFE_OR_DOT = "[^a-zA-Z0-9:_.]"  # the separator is let through


def is_blank(c: Column) -> Column:
    """True for null and for the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def full_match(c: Column, pattern: str) -> Column:
    """Whole-string regex match; an empty pattern matches only the empty string."""
    return c.rlike(r"\A(?:" + pattern + r")\z")


def scope_path(scope: Column) -> Column:
    """Dotted scope → array of clean components; trailing empty components vanish."""
    trimmed = F.rtrim(scope, F.lit("."))
    parts = F.split(F.regexp_replace(trimmed, SCOPE_UNSAFE_OR_DOT, "_"), r"\.", -1)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(parts)


def has_scope(scope: Column) -> Column:
    """True when the scope names at least one component."""
    return F.coalesce(F.rtrim(scope, F.lit(".")) != "", F.lit(False))


def label(header: Column, name: str) -> Column:
    """Value of one label; null when the label is absent."""
    return F.try_element_at(header, F.lit(name))
