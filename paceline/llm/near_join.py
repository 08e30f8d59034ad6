"""Join of similar texts: MinHash LSH forest, then exact Jaccard similarity of word shingles.

Texts with the same shingles are one class; one signature stands for all of them. A signature is
cut into trees of a few labels each. Prefixes of a tree's labels are the paths of its trie: texts
that share a path are candidates. The first round asks for the longest prefixes; later ones
shorten them, by what was found, down to the length that finds pairs at the threshold with the
target recall.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.components import components
from paceline.llm.grouped import runs
from paceline.llm.words import shingles
from paceline.session import saved


@dataclass(frozen=True)
class Settings:
    """margin: how far below the threshold the estimate of a candidate may be before it is not
    verified, over five standard deviations of the estimate. block: texts of a bucket that are
    compared at once; a larger bucket is cut into blocks, and pairs of blocks are shared out."""

    words: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 8
    recall: float = 0.998
    margin: float = 0.2
    block: int = 256
    seed: int = 7

    def found(self, similarity: float, depth: int) -> float:
        """The chance that some tree has a common prefix of this length."""
        return 1 - (1 - similarity**depth) ** self.trees

    def depth_for(self, similarity: float) -> int:
        """The longest prefix that meets the target recall at a similarity."""
        good = [d for d in range(1, self.depth + 1) if self.found(similarity, d) >= self.recall]
        return max(good, default=1)


def permutations(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(settings.seed))
    size = settings.trees * settings.depth
    return (
        rng.integers(0, 1 << 32, size, np.uint32)[:, None],
        rng.integers(0, 1 << 31, size, np.uint32)[:, None] * np.uint32(2) + np.uint32(1),
    )


def signature(found: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16-bit labels of the smallest permuted hashes."""
    low, best = (found >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(low), 2048):
        part = ((low[None, at : at + 2048] ^ flips) * factors).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def print_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def written() -> Column:
    """Hash of a text as it is; the copies of a class may be written differently."""
    return F.unhex(F.md5("text")).alias("written")


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, fingerprint of the shingles, signature and hash of the text; fingerprint and signature
    are null for a text without words."""

    def run(batches):
        flips, factors = permutations(settings)
        for batch in batches:
            prints, labels = [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, settings.words)
                prints.append(print_of(found) if len(found) else None)
                labels.append(signature(found, flips, factors).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(prints, pa.binary()),
                    pa.array(labels, pa.binary()),
                    batch.column(2),
                ],
                ["doc_id", "fp", "sig", "written"],
            )

    rows = docs.select("doc_id", "text", written())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp binary, sig binary, written binary")


def cells(classes: DataFrame, depth: int, settings: Settings) -> DataFrame:
    """The paths of a class in all tries, cut at a depth: (tree, cell) for each tree."""
    labels = 2 * settings.depth
    paths = [
        F.struct(
            F.lit(t).cast("byte").alias("tree"),
            F.xxhash64(F.substring("sig", t * labels + 1, 2 * depth)).alias("cell"),
        )
        for t in range(settings.trees)
    ]
    return classes.select("fp", F.explode(F.array(*paths)).alias("path")).select("fp", "path.*")


GROUP = ["tree", "cell", "i", "j"]


def blocks(classes: DataFrame, depth: int, settings: Settings) -> DataFrame:
    """Rows of all buckets of two classes at least, as pairs (i, j) of blocks.

    Bucket sizes are counted beforehand, so a large bucket is dealt out by a hash of the class:
    a block meets every block of its bucket in a group of its own. side is 1 in block j.
    """
    paths = cells(classes, depth, settings)
    sizes = paths.groupBy("tree", "cell").agg(F.count("*").alias("size")).where("size > 1")
    n = F.ceil(F.col("size") / settings.block)
    slot = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    placed = (
        paths.join(sizes, ["tree", "cell"])
        .withColumn("n", n)
        .withColumn("slot", slot)
        .select("tree", "cell", "fp", "slot", partner.alias("other"))
        .select(
            "tree",
            "cell",
            F.least("slot", "other").alias("i"),
            F.greatest("slot", "other").alias("j"),
            (F.col("slot") > F.col("other")).cast("byte").alias("side"),
            "fp",
        )
    )
    return placed.join(classes.select("fp", "written", "copies", "sig"), "fp")


def dealt(rows: DataFrame) -> DataFrame:
    """Every group in one task, its rows next to each other."""
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def pairs(sigs: np.ndarray, sides: np.ndarray, tree: int, depths: list[int], settings: Settings):
    """Pairs (mask, estimate) that this tree is the first to find at the last of the depths, and
    that no tree found at an earlier one."""
    cut = sigs.reshape(len(sigs), settings.trees, settings.depth)
    same = cut[:, None] == cut[None]
    fresh = same[..., : depths[-1]].all(-1)
    mask = fresh[..., tree] & ~fresh[..., :tree].any(-1)
    for depth in depths[:-1]:
        mask &= ~same[..., :depth].all(-1).any(-1)
    if sides.any():
        mask &= (sides[:, None] == 0) & (sides[None] == 1)
    else:
        mask &= np.tri(len(sigs), k=-1, dtype=bool).T
    estimate = same.mean((-1, -2))
    return mask & (estimate >= settings.threshold - settings.margin), estimate


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


STRATA = 0.05


def candidates(classes: DataFrame, depths: list[int], settings: Settings) -> DataFrame:
    """The members of every group that are in a candidate pair, one row each.

    low is the least stratum of estimated similarity among the member's candidate pairs.
    """

    def run(batches):
        for table, cuts in runs(batches, GROUP):
            sigs, trees = matrix(table["sig"]), table["tree"].to_numpy()
            sides = table["side"].to_numpy()
            keep, low = np.zeros(len(sigs), bool), np.ones(len(sigs))
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end - start < 2:
                    continue
                mask, estimate = pairs(
                    sigs[start:end], sides[start:end], trees[start], depths, settings
                )
                if mask.any():
                    mask |= mask.T
                    keep[start:end] = mask.any(0)
                    close = mask & (estimate >= settings.threshold - STRATA)
                    low[start:end] = np.where(close, np.floor(estimate / STRATA) * STRATA, 1).min(0)
            at = np.flatnonzero(keep)
            if len(at):
                out = table.select([*GROUP, "side", "fp", "written", "copies"]).take(at)
                out = out.append_column("low", pa.array(low[at]))
                yield from out.combine_chunks().to_batches()

    rows = blocks(classes, depths[-1], settings)
    return dealt(rows).mapInArrow(
        run,
        "tree byte, cell long, i int, j int, side byte, fp binary, written binary, copies long,"
        " low double",
    )


def overlaps(sets: list[np.ndarray], mask: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the masked pairs of sets."""
    size = len(sets)
    if mask.sum() <= size:
        out = np.zeros((size, size))
        for a, b in np.argwhere(mask):
            out[a, b] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    owner = np.repeat(np.arange(size), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    out, width = np.zeros((size, size), np.float32), max(1, (1 << 22) // size)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((size, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out


def verified(
    found: DataFrame, docs: DataFrame, tried: list[int], settings: Settings
) -> DataFrame:
    """Per member of a group its links in it, as (fp, links, root), from the whole texts.

    links counts documents, copies included; root is the least member that links lead to.
    """

    def run(batches):
        flips, factors = permutations(settings)
        for table, cuts in runs(batches, ["depth", *GROUP]):
            texts, prints = table["text"], table["fp"].to_pylist()
            trees, sides = table["tree"].to_numpy(), table["side"].to_numpy()
            copies, levels = table["copies"].to_numpy(), table["depth"].to_numpy()
            out: list[tuple[bytes, int, bytes]] = []
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                sets = [shingles(t.as_py(), settings.words) for t in texts[start:end]]
                own = [
                    k for k, s in enumerate(sets) if len(s) and print_of(s) == prints[start + k]
                ]
                if len(own) < 2:
                    continue
                sets, at = [sets[k] for k in own], start + np.array(own)
                depths = [d for d in tried if d >= levels[start]]
                sigs = np.stack([signature(s, flips, factors) for s in sets])
                mask, _ = pairs(sigs, sides[at], trees[start], depths, settings)
                if not mask.any():
                    continue
                common, sizes = overlaps(sets, mask), np.array([len(s) for s in sets])
                near = mask & (
                    common / (sizes[:, None] + sizes[None] - common) >= settings.threshold
                )
                near |= near.T
                links = near @ copies[at]
                names = [prints[k] for k in at]
                for k, root in roots(near, names).items():
                    out.append((names[k], int(links[k]), root))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.binary()),
                        pa.array([x[1] for x in out], pa.int64()),
                        pa.array([x[2] for x in out], pa.binary()),
                    ],
                    ["fp", "links", "root"],
                )

    # One text a class, however often it is stored.
    texts = (
        docs.select(written(), "text")
        .join(found.select("written").distinct(), "written", "left_semi")
        .dropDuplicates(["written"])
    )
    rows = found.join(texts, "written").select(
        "depth", *GROUP, "side", "fp", "copies", "text"
    )
    return (
        rows.repartition("depth", *GROUP)
        .sortWithinPartitions("depth", *GROUP)
        .mapInArrow(run, "fp binary, links long, root binary")
    )


def roots(near: np.ndarray, names: list[bytes]) -> dict[int, bytes]:
    """For each member with a link, the least name that links inside the group lead to."""
    root = list(range(len(names)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in np.argwhere(np.triu(near)):
        x, y = top(a), top(b)
        if x != y:
            x, y = (x, y) if names[x] < names[y] else (y, x)
            root[y] = x
    return {k: names[top(k)] for k in np.flatnonzero(near.any(0))}


def near_join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, class_id and n_links of every row of docs (doc_id, text).

    n_links counts the other rows whose shingles have at least the threshold's Jaccard similarity
    with the row's, copies included. class_id is the smallest doc_id of the row's component of
    links; copies always share a class. A text without words (null, empty) is a class of its own
    without links, and so is a row alone; a null doc_id comes back as it is, and its class is null
    only if no member has an id. A text of fewer words than a shingle has is one shingle.
    """
    rows = saved(signatures(docs, settings))
    classes = saved(
        rows.where("fp is not null")
        .groupBy("fp")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.count("*").alias("copies"),
            F.first("sig").alias("sig"),
            F.first("written").alias("written"),
        )
    )
    depths, parts, last = [settings.depth], [], settings.depth_for(settings.threshold)
    while True:
        part = saved(candidates(classes, depths, settings))
        parts.append(part.withColumn("depth", F.lit(depths[-1])))
        if depths[-1] <= last:
            break
        low = part.agg(F.min("low")).first()[0]
        step = last if low is None else settings.depth_for(max(settings.threshold, low))
        depths.append(step if step < depths[-1] else last)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    links = saved(verified(found, docs, depths, settings))
    joined = components(links.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    summed = links.groupBy("fp").agg(F.sum("links").alias("links"))
    return classed(rows.drop("sig", "written"), classes.drop("sig", "written"), joined, summed)


def classed(rows: DataFrame, classes: DataFrame, joined: DataFrame, links: DataFrame) -> DataFrame:
    root: Column = F.coalesce("root", "fp")
    named = (
        classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("root", root)
        .join(links, "fp", "left")
    )
    least = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    known = named.join(least, "root").select(
        "fp", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return rows.join(known, "fp", "left").select(
        "doc_id",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
