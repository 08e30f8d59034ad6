"""Chat formatting: drop logged conversations that a longer one repeats, render the rest.

A log that saves a chat after every turn holds each chat many times, as ever longer prefixes.
Rolling hashes of the turns find them: the hash of a whole conversation is then the hash of a
proper prefix of a longer one.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written; ``guard`` replaces the opening mark where a text holds it itself."""

    opening: str = "<|"
    closing: str = "|>"
    guard: str = "< |"
    end: str = "<|end|>"


def turn_hash() -> Column:
    """Hash of one turn: role and text with their lengths, a null told from an empty string."""
    parts = [
        F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
        for c in ("role", "text")
    ]
    return F.md5(F.concat(parts[0], F.lit(";"), parts[1]))


def prefix_hashes(turns: Column) -> Column:
    """Hash of every prefix of an array of turn hashes, from the shortest to the whole."""
    return F.aggregate(
        turns,
        F.array().cast("array<string>"),
        lambda seen, turn: F.concat(
            seen, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit("")), turn)))
        ),
    )


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that no other one continues.

    Of equal conversations the one with the smallest id stands for all, ``copies`` says for how
    many. Turns are put in order of (turn, hash of role and text), nulls first; a row that occurs
    twice counts once. Rows without a conv_id belong to no conversation and are left out.
    """
    rows = turns.where("conv_id is not null").select("conv_id", "turn", turn_hash().alias("hash"))
    hashes = (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_set(F.struct("turn", "hash"))).alias("turns"))
        .select("conv_id", prefix_hashes(F.col("turns.hash")).alias("prefixes"))
    )
    whole = (
        hashes.groupBy(F.element_at("prefixes", -1).alias("hash"))
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.first(F.size("prefixes")).alias("n_turns"),
            F.count("*").alias("copies"),
        )
    )
    proper = (
        hashes.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("hash"))
        .distinct()
    )
    return whole.join(proper, "hash", "left_anti").drop("hash")


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, copies and the rendered chat of every maximal conversation.

    A null role is written as ``unknown``, a null text as an empty one.
    """
    kept = collapse(turns)
    turn = F.concat(
        F.lit(template.opening),
        F.coalesce(guarded("role", template), F.lit("unknown")),
        F.lit(template.closing + "\n"),
        F.coalesce(guarded("text", template), F.lit("")),
        F.lit("\n" + template.end + "\n"),
    )
    rows = turns.select("conv_id", "turn", turn_hash().alias("hash"), turn.alias("rendered"))
    return (
        rows.join(kept, "conv_id")
        .groupBy("conv_id")
        .agg(
            F.first("n_turns").cast("long").alias("n_turns"),
            F.first("copies").alias("copies"),
            F.sort_array(F.collect_set(F.struct("turn", "hash", "rendered"))).alias("turns"),
        )
        .select("conv_id", "n_turns", "copies", F.array_join("turns.rendered", "").alias("chat"))
    )


def guarded(column: str, template: Template) -> Column:
    """The text without marks that a reader of the chat would take for its own."""
    return F.replace(F.col(column), F.lit(template.opening), F.lit(template.guard))
