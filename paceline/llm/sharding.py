"""Sharding by rendezvous hashing: records keep their shard when the number of shards changes.

Every shard bids for every key, and the highest bid wins. A bid depends on the key and the shard
alone, so a further shard only takes keys for itself, and a lost one only gives away its own.
Everything is built of column functions.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.session import saved

#: Hexadecimal digits of a digest that make a bid: 52 bits, all of which a double holds.
DIGITS = 13


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0


def equal_shards(count: int) -> tuple[Shard, ...]:
    return tuple(Shard(i) for i in range(count))


@dataclass(frozen=True)
class Slots:
    """Slots are numbered by buckets of a shard, 16 to the power of ``digits``; of a row that is
    stored more often than ``copies`` times the rest goes to other buckets."""

    digits: int = 4
    copies: int = 100_000


def key_text(*columns: Column) -> Column:
    """One text for each key; a null is a value of its own."""
    if len(columns) == 1:
        return F.coalesce(columns[0].cast("string"), F.lit("null"))
    return F.to_json(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(columns))))


def winner(key: Column, shards: Sequence[Shard]) -> Column:
    """The shard with the highest bid for a key, ties to the smaller number.

    A bid is -weight / ln(u) of a hash u between 0 and 1: a shard wins in proportion to its weight.
    Shards without weight win nothing.
    """
    bidders = [s for s in shards if s.weight > 0]
    if not bidders or len({s.number for s in bidders}) < len(bidders):
        raise ValueError("shards need weights above 0 and different numbers")
    known = F.array(
        *(F.struct(F.lit(s.number).alias("number"), F.lit(float(s.weight)).alias("weight")) for s in bidders)
    )

    def bid(key: Column, shard: Column) -> Column:
        digest = F.substring(F.md5(F.concat_ws(":", key, shard["number"].cast("string"))), 1, DIGITS)
        u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
        return F.struct((-shard["weight"] / F.ln(u)).alias("bid"), (-shard["number"]).alias("n"))

    # the key is worked out once, not anew for each shard
    best = F.transform(F.array(key), lambda k: F.array_max(F.transform(known, lambda s: bid(k, s))))
    return (-F.element_at(best, 1)["n"]).cast("int")


def sharded(
    rows: DataFrame,
    key: Sequence[str],
    shards: Sequence[Shard],
    grown: Sequence[Shard] | None = None,
    spread: Column | None = None,
    slots: Slots = Slots(),
) -> DataFrame:
    """All rows with shard, slot and, if ``grown`` is given, grown_shard, their shard among those.

    The shard depends on the columns ``key`` alone, rows with equal keys share it, null keys too.
    slot numbers the rows of a shard from 0 without gaps, in the order of buckets, then of the
    rows' values; ``spread``, a text (by default a hash of the row), deals the rows of one key out to buckets.
    Repeated rows get a slot each. Other columns pass through, those with the names of new ones
    are replaced; columns of maps cannot be compared and are refused by Spark. No rows give none.

    Repeated rows are counted before anything is shuffled by value and cut into pieces of
    bounded size, so neither a key nor a row that is stored very often ends up in one task.
    """
    new = ["shard", "slot"] + (["grown_shard"] if grown is not None else [])
    kept = [c for c in rows.columns if c not in new]
    text = key_text(*(F.col(f"`{c}`") for c in key))
    row = F.struct(*(F.col(f"`{c}`") for c in kept))
    spread = F.xxhash64(row).cast("string") if spread is None else spread
    counted = (
        rows.select(row.alias("row"), text.alias("key"), F.coalesce(spread, F.lit("null")).alias("spread"))
        .groupBy("row", "key", "spread")
        .agg(F.count("*").alias("n"))
    )
    last = F.floor((F.col("n") - 1) / slots.copies)
    pieces = counted.select(
        "row", "key", "spread", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")
    )
    place = F.concat_ws(
        "#", "key", "spread", F.when(F.col("piece") > 0, F.col("piece").cast("string"))
    )
    placed = saved(
        pieces.select(
            "row",
            "piece",
            winner(F.col("key"), shards).alias("shard"),
            *([winner(F.col("key"), grown).alias("grown_shard")] if grown is not None else []),
            F.substring(F.md5(place), 1, slots.digits).alias("bucket"),
            F.least(F.lit(slots.copies).cast("long"), F.col("n") - F.col("piece") * slots.copies).alias("n"),
        )
    )
    # at most 16 ** digits sums a shard
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "bucket")
        .agg(F.sum("n").alias("all"))
        .select("shard", "bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("row", "piece")
    first = F.col("start") + F.sum("n").over(inside) - F.col("n")
    numbered = placed.join(starts, ["shard", "bucket"]).withColumn("first", first)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    out = numbered.select("row", *(c for c in new if c != "slot"), "first", each.alias("i"))
    return out.select(
        *(F.col("row").getField(c).alias(c) for c in kept),
        "shard",
        (F.col("first") + F.col("i")).alias("slot"),
        *(["grown_shard"] if grown is not None else []),
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Write sharded rows as one folder a shard, each file in the order of slots.

    Slots are dealt out in ranges, so a large shard is written by many tasks.
    """
    (
        placed.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def document_shards(docs: DataFrame, count: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    The law is ``key``: doc_id and the number of shards decide. size is the UTF-8 bytes of the
    text plus 1, text_crc32 its unsigned checksum; a null text counts as an empty one for both.
    Documents without an id are one key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    spread = F.concat_ws(":", F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    out = sharded(sized, ["doc_id"], equal_shards(count), equal_shards(count + 1), spread)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
