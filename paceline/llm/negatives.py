"""Hard negatives by a multiway hyperplane tree whose split points know the distances to all siblings.

A node has some split points; a vector belongs to the nearest one. For each split point and each
sibling subtree the least and greatest distance to the vectors in it are kept, and the norms in the
subtree. A window of inner products is an annulus around the query, once norms are bounded; a subtree goes where
the ranges seen from any split point miss all annuli. The leaves left over are searched exactly.

The tree has a bounded number of leaves. It is chosen from a bounded sample, but ranges are taken over all
vectors, so results are exact. Leaves are cut into blocks of bounded size, which are tasks.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.session import saved

LONG = 2**63 - 1
KEYS = ["dim", "cell", "block", "slice"]


@dataclass(frozen=True)
class Settings:
    """A negative's score is between ``low`` percent of the positive's and all of it.

    A node has ``fanout`` split points, chosen among the ``sample`` vectors with the least hashes
    (of each length); there are at most ``depth`` levels. Blocks of a leaf have some ``block_rows`` vectors
    and meet some ``block_queries`` queries at a time. Lengths of vectors beyond the ``lengths``
    most frequent ones get a single leaf.
    """

    positives: int = 5
    negatives: int = 5
    low: int = 80
    fanout: int = 16
    depth: int = 3
    sample: int = 4096
    lengths: int = 8
    block_rows: int = 8192
    block_queries: int = 65536


@dataclass
class Node:
    """Split points, and for each of them the node or, negative, the leaf it leads to.

    near and far [i, j]: distances from point i to the vectors of subtree j; norms [j]: least and greatest."""

    points: np.ndarray
    children: list[int]
    near: np.ndarray = field(default=None)
    far: np.ndarray = field(default=None)
    norms: np.ndarray = field(default=None)

    def __post_init__(self):
        m = len(self.points)
        self.near, self.far = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        self.norms = np.stack([np.full(m, np.inf), np.full(m, -np.inf)])


Tree = list[Node]


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """From all rows to all points, by differences, so that near ones are exact."""
    out = np.empty((len(rows), len(points)))
    for j, point in enumerate(points):
        out[:, j] = np.sqrt(((rows - point) ** 2).sum(1))
    return out


def split_points(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: the one farthest from those chosen comes next."""
    chosen, nearest = [0], distances(rows, rows[:1])[:, 0]
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def grown(sample: np.ndarray, rows: int, settings: Settings) -> Tree:
    """A tree for so many rows, without ranges; no nodes if one leaf is enough."""
    tree: Tree = []
    leaves = 0

    def grow(part: np.ndarray, rows: float, depth: int) -> int:
        nonlocal leaves
        if depth and rows > settings.block_rows and len(part) > 1:
            points = split_points(part[: 8 * settings.fanout], settings.fanout)
            if len(points) > 1:
                own = distances(part, points).argmin(1)
                node, at = Node(points, []), len(tree)
                tree.append(node)
                for j in range(len(points)):
                    share = part[own == j]
                    node.children.append(grow(share, rows * len(share) / len(part), depth - 1))
                return at
        leaves += 1
        return -leaves

    grow(sample, rows, settings.depth)
    return tree


def placed(tree: Tree, rows: np.ndarray, ranges: bool = False) -> np.ndarray:
    """The leaf of each row; with ``ranges`` the nodes' ranges are widened to hold the rows."""
    cells = np.zeros(len(rows), np.int32)
    norms = np.sqrt((rows**2).sum(1))
    todo = [(0, np.arange(len(rows)))] if tree else []
    while todo:
        at, index = todo.pop()
        node, from_points = tree[at], distances(rows[index], tree[at].points)
        own = from_points.argmin(1)
        for j, child in enumerate(node.children):
            mine = index[own == j]
            if not len(mine):
                continue
            if ranges:
                seen = from_points[own == j]
                node.near[:, j] = np.minimum(node.near[:, j], seen.min(0))
                node.far[:, j] = np.maximum(node.far[:, j], seen.max(0))
                node.norms[0, j] = min(node.norms[0, j], norms[mine].min())
                node.norms[1, j] = max(node.norms[1, j], norms[mine].max())
            if child < 0:
                cells[mine] = -child
            else:
                todo.append((child, mine))
    return cells


def survivors(tree: Tree, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(numbers of queries, leaf) for each leaf that may hold scores from low to high (one column a window).

    Rounding is allowed for: a subtree goes only if it misses every window by some margin.
    """
    size = np.sqrt((asked**2).sum(1))
    todo = [(0, np.arange(len(asked)))] if tree else []
    if not tree:
        yield np.arange(len(asked)), 0
    with np.errstate(invalid="ignore", over="ignore"):
        while todo:
            at, index = todo.pop()
            node, q = tree[at], size[index, None]
            seen = distances(asked[index], node.points)
            for j, child in enumerate(node.children):
                least, most = node.norms[:, j]
                if least > most:
                    continue  # nothing is in it
                closest = np.maximum(seen - node.far[:, j], node.near[:, j] - seen).max(1)[:, None]
                farthest = (seen + node.far[:, j]).min(1)[:, None]
                margin = 1e-6 * (1 + q + most)
                top = np.minimum(high[index], q * most)
                inner = np.sqrt(np.maximum(q**2 + least**2 - 2 * top, 0))
                outer = q**2 + most**2 - 2 * low[index]
                missed = (low[index] > q * most * (1 + 1e-9) + 1e-6) | (outer < -(margin**2))
                missed |= closest > np.sqrt(np.maximum(outer, 0)) + margin
                missed |= farthest < inner - margin
                stay = index[~missed.all(1)]
                if len(stay) and child < 0:
                    yield stay, -child
                elif len(stay):
                    todo.append((child, stay))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def scores(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where these hold them, else in Python's numbers."""
    most = max((abs(x).max(initial=0) for x in (rows, asked)), default=0)
    if rows.shape[1] * most * most < 2.0**53:
        return asked @ rows.T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (asked, rows)]
    return whole[0] @ whole[1].T


def best(score: np.ndarray, index: np.ndarray, count: int) -> np.ndarray:
    """Of the rows at index, in the order of ids, those with the highest scores, earlier ones first."""
    if len(index) > count:
        own = score[index]
        index = index[own >= np.partition(own, len(own) - count)[len(own) - count]]
    return index[np.argsort(-score[index], kind="stable")[:count]]


def usable(vector: Column) -> Column:
    """Not null, and every component finite, times 256 too."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) < float("inf"))
    )
    return vector.isNotNull() & finite


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of every component, as doubles, which hold these numbers exactly."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * 256
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def trees_of(entries: DataFrame, settings: Settings) -> dict[int, Tree]:
    """A tree for each frequent length of vectors, with the ranges of all entries."""
    sizes = entries.groupBy("dim").agg(F.count("*").alias("n"))
    many = sizes.where(F.col("n") > settings.block_rows).orderBy(F.desc("n"), "dim")
    trees = {}
    for dim, n in many.limit(settings.lengths).collect():
        some = entries.where(F.col("dim") == dim).select("h", "vector").orderBy("h").limit(settings.sample)
        rows = np.array([r["vector"] for r in some.collect()], np.float64)
        if tree := grown(rows, n, settings):
            trees[dim] = tree
    if not trees:
        return trees

    def partial(batches):
        own = {
            dim: [Node(x.points, x.children) for x in tree] for dim, tree in trees.items()
        }
        for batch in batches:
            for dim, index in lengths(batch):
                if dim in own:
                    placed(own[dim], matrix(batch["vector"].take(pa.array(index)), dim), True)
        found = [
            (dim, k, i, j, x.near[i, j], x.far[i, j], *x.norms[:, j])
            for dim, tree in own.items()
            for k, x in enumerate(tree)
            for i in range(len(x.points))
            for j in range(len(x.points))
            if x.near[i, j] <= x.far[i, j]
        ]
        names = ["dim", "node", "i", "j", "near", "far", "least", "most"]
        types = [pa.int32()] * 4 + [pa.float64()] * 4
        columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
        )

    ranges = (
        entries.select("dim", "vector")
        .mapInArrow(partial, "dim int, node int, i int, j int, near double, far double, least double, most double")
        .groupBy("dim", "node", "i", "j")
        .agg(F.min("near"), F.max("far"), F.min("least"), F.max("most"))
    )
    for dim, k, i, j, near, far, least, most in ranges.collect():
        node = trees[dim][k]
        node.near[i, j], node.far[i, j] = near, far
        node.norms[:, j] = least, most
    return trees


def lengths(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(length, numbers of rows) of the vectors of a batch."""
    dims = batch["dim"].to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def with_cells(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """The rows with the leaf of their vector."""

    def run(batches):
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            for dim, index in lengths(batch):
                if dim in trees:
                    cells[index] = placed(trees[dim], matrix(batch["vector"].take(pa.array(index)), dim))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, cell int")


def reached(asked: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(probe, dim, cell) of every leaf that a window of the probe may reach."""

    def run(batches):
        for batch in batches:
            for dim, every in lengths(batch):
                for at in range(0, len(every), 1024):
                    part = batch.take(pa.array(every[at : at + 1024]))
                    probes = part["probe"].to_numpy()
                    bounds = [part[c].to_pylist() for c in ("low", "high")]
                    width = max(map(len, bounds[0]))
                    low, high = (
                        np.array([b + b[:1] * (width - len(b)) for b in x], np.float64) for x in bounds
                    )
                    vectors = matrix(part["vector"], dim)
                    for index, cell in survivors(trees.get(dim, []), vectors, low, high):
                        size = len(index)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(probes[index]),
                                pa.array(np.full(size, dim, np.int32)),
                                pa.array(np.full(size, cell, np.int32)),
                            ],
                            ["probe", "dim", "cell"],
                        )

    return asked.select("probe", "dim", "vector", "low", "high").mapInArrow(
        run, "probe long, dim int, cell int"
    )


def searched(leaves: DataFrame, tasks: DataFrame, same: bool, count: int, settings: Settings) -> DataFrame:
    """(probe, high, vec_id, score, twin): the best of each block for each window of each task.

    tasks are (dim, cell, block, probe, label, vector, low, high), the last two arrays of windows.
    Rows with the label of the probe count if ``same``, all others if not. twin marks a row with
    the vector of the probe. Blocks that meet many queries are copied, a copy for a slice of them.
    """
    slices = tasks.groupBy("dim", "cell", "block").agg(
        F.ceil(F.count("*") / settings.block_queries).cast("int").alias("slices")
    )
    rows = (
        leaves.join(slices, ["dim", "cell", "block"])
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(*KEYS, F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "vector")
    )
    asked = tasks.join(slices, ["dim", "cell", "block"]).select(
        "dim",
        "cell",
        "block",
        F.pmod(F.xxhash64("probe"), F.col("slices")).cast("int").alias("slice"),
        F.lit(1).alias("kind"),
        F.col("probe").alias("id"),
        "label",
        "vector",
        "low",
        "high",
    )
    out = pa.schema(
        [("probe", pa.int64()), ("high", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("twin", pa.bool_())]
    )

    def run(batches):
        key, parts, leaf = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch[c].to_numpy() for c in (*KEYS, "kind")], 1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                part, own = batch.slice(start, end - start), tuple(marks[start, :4])
                if own != key:
                    key, parts, leaf = own, [], None
                piece = tuple(part[c].to_numpy() for c in ("id", "label")) + (matrix(part["vector"], int(own[0])),)
                if marks[start, 4] == 0:
                    parts.append(piece)
                elif parts:
                    if leaf is None:
                        leaf = [np.concatenate(x) for x in zip(*parts, strict=True)]
                        order = np.argsort(leaf[0], kind="stable")
                        leaf = [x[order] for x in leaf]
                    yield from answers(leaf, piece, part["low"].to_pylist(), part["high"].to_pylist())

    def answers(leaf, piece, lows, highs):
        ids, labels, rows = leaf
        found = []
        for at in range(0, len(lows), 256):
            asked = piece[2][at : at + 256]
            for k, score in enumerate(scores(rows, asked), at):
                fits = (labels == piece[1][k]) == same
                for low, high in zip(lows[k], highs[k], strict=True):
                    index = np.flatnonzero(fits & (score >= low) & (score <= high) & (score <= LONG))
                    for i in best(score, index, count):
                        twin = bool((rows[i] == piece[2][k]).all())
                        found.append((int(piece[0][k]), high, int(ids[i]), int(score[i]), twin))
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out
        )

    both = rows.unionByName(asked, allowMissingColumns=True)
    return (
        both.repartition(*KEYS)
        .sortWithinPartitions(*KEYS, "kind")
        .mapInArrow(run, "probe long, high long, vec_id long, score long, twin boolean")
    )


def top(found: DataFrame, by: list[str], count: int) -> DataFrame:
    """The first of each group with their rank: higher scores first, then smaller ids."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "twin")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(items: DataFrame, anchors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both tables are (vec_id, label, vector) with vectors of whole numbers, see
    :func:`whole_numbers`. A score is the exact inner product. The positives of an anchor are the
    first rows with its label, higher scores first and ties to the smaller vec_id; for each of them come the
    first rows with another label whose score is between ``low`` percent of the positive's and all of it.
    A negative positive's score leaves no room for any. Rows without id, label or vector take no part; repeated
    rows count once, and the row that is the anchor is not its own positive. Vectors of different lengths never meet.
    A pair whose score is no long ranks nowhere. Empty tables give no rows.
    """
    complete = "vec_id is not null and label is not null and vector is not null"
    keep = max(settings.positives + 1, settings.negatives)

    def tidy(rows: DataFrame) -> DataFrame:
        return (
            rows.where(complete)
            .select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector")
            .distinct()
            .withColumns({"dim": F.size("vector"), "h": F.xxhash64("vector")})
        )

    equal = Window.partitionBy("h", "vector", "label").orderBy("vec_id")
    entries = saved(
        tidy(items)
        .withColumn("nth", F.row_number().over(equal))
        .where(F.col("nth") <= keep)  # no result has more of equal rows
        .drop("nth")
    )
    trees = trees_of(entries, settings)
    celled = saved(with_cells(entries, trees))
    counts = saved(
        celled.groupBy("dim", "cell").agg(
            F.ceil(F.count("*") / settings.block_rows).cast("int").alias("blocks")
        )
    )
    leaves = celled.join(counts, ["dim", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("h", "vec_id"), F.col("blocks")).cast("int")
    ).select("dim", "cell", "block", "vec_id", "label", "vector")

    named = saved(tidy(anchors))
    probes = saved(
        with_cells(
            named.select("h", "vector", "label", "dim").distinct(), trees
        ).withColumn("probe", F.monotonically_increasing_id())
    )
    window = probes.select("probe", "dim", "label", "vector")

    def within(low: Column, high: Column) -> list[Column]:
        return [low.alias("low"), high.alias("high")]

    whole = within(F.array(F.lit(-LONG - 1)), F.array(F.lit(LONG)))
    size = settings.positives + 1
    at_home = probes.join(counts, ["dim", "cell"]).select(
        "dim", "cell", F.pmod("h", "blocks").cast("int").alias("block"), "probe", "label", "vector", *whole
    )
    near = top(searched(leaves, at_home, True, size, settings), ["probe"], size)
    bound = near.where(F.col("rank") == size).select("probe", "score")
    asked = saved(
        window.join(bound, "probe", "left").select(
            *window.columns,
            *within(F.array(F.coalesce("score", F.lit(-LONG - 1))), F.array(F.lit(LONG))),
        )
    )

    def sent(asked: DataFrame) -> DataFrame:
        return (
            reached(asked, trees)
            .join(counts, ["dim", "cell"])
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("probe", "cell", "block")
            .join(asked, "probe")
        )

    kin = saved(top(searched(leaves, sent(asked), True, size, settings), ["probe"], size))
    room = kin.where("score >= 0").select("probe", "score").distinct()
    windows = room.groupBy("probe").agg(
        F.array_sort(F.collect_set("score")).alias("high")
    ).withColumn(
        "low", F.transform("high", lambda p: F.ceil(p.cast("decimal(38,0)") * settings.low / 100).cast("long"))
    )
    asked = saved(window.join(windows, "probe").select(*window.columns, "low", "high"))
    others = top(
        searched(leaves, sent(asked), False, settings.negatives, settings), ["probe", "high"], settings.negatives
    ).select("probe", F.col("high").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))

    mine = named.join(
        probes.select("probe", "h", "vector", "label"), ["h", "vector", "label"]
    ).select("probe", F.col("vec_id").alias("anchor_id"))
    own = F.col("twin") & (F.col("vec_id") == F.col("anchor_id"))
    order = Window.partitionBy("anchor_id", "probe").orderBy("nth")
    positives = (
        mine.join(kin.withColumnRenamed("rank", "nth"), "probe")
        .where(~own)
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= settings.positives)
        .select("probe", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    return positives.join(others, ["probe", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
