"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node of a graph. A shard holds a bounded number of nodes; its graph is built
in bulk, a level at a time, and stored as flat neighbour arrays. Blocks of queries search every
shard, and the shards' results are merged.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.grouped import runs
from paceline.session import saved


@dataclass(frozen=True)
class Settings:
    """links: neighbours of a node on upper levels, twice as many on the lowest. near: nearest
    nodes that are considered as neighbours. beam: nodes a search keeps."""

    k: int = 10
    shard_rows: int = 4096
    query_block: int = 512
    links: int = 16
    near: int = 48
    beam: int = 64


def usable(vector: Column) -> Column:
    """Not null or empty, every component finite, and not all of them zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def frame(matrix: np.ndarray) -> tuple[np.ndarray, float]:
    """(centre, radius) of the rows: a graph works on rows less the centre by the radius, so that
    single precision serves vectors of any magnitude and any distance from the origin."""
    unit = np.abs(matrix).max(initial=0) or 1.0
    centre = (matrix / unit).mean(0) * unit if len(matrix) else np.zeros(matrix.shape[1])
    return centre, np.abs(matrix - centre).max(initial=0) or unit


def fitted(rows: np.ndarray, centre: np.ndarray, radius: float, most: float = 1e3) -> np.ndarray:
    """Rows in a frame. One that is far outside is moved along its direction to where the order of
    distances is that of the far point, but single precision still tells them apart."""
    out = (rows - centre) / radius
    far = np.abs(out).max(axis=1, initial=0)
    out = out / np.where(far > most, far / most, 1.0)[:, None]
    return out.astype(np.float32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, for the choice of neighbours."""
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(out, 0)


def diverse(every: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """Of the nearest nodes, in order, those closer to the node than to any chosen one.

    every has all distances. Free places are filled with the nearest of the others.
    """
    size, width = near.shape
    chosen = np.zeros((size, width), bool)
    rows = np.arange(size)
    own = every[rows[:, None], near]
    for i in range(width):
        kept = every[near[:, i][:, None], near[:, :i]] <= own[:, i][:, None]
        blocked = (kept & chosen[:, :i]).any(1)
        chosen[:, i] = ~blocked & (chosen.sum(1) < links)
    rank = np.where(chosen, 0, width) + np.arange(width)[None]
    return np.take_along_axis(near, np.argsort(rank, axis=1)[:, :links], 1)


def level_graph(vectors: np.ndarray, links: int, near: int) -> np.ndarray:
    """Neighbours of every node, -1 where there are fewer; each node can be reached from the first.

    Links lead both ways as far as there is room, nearer ones first.
    """
    size = len(vectors)
    if size < 2:
        return np.full((size, 1), -1, np.int32)
    every = np.empty((size, size), np.float32)
    near = min(near, size - 1)
    first = np.empty((size, near), np.int64)
    for at in range(0, size, 512):
        block = distances(vectors[at : at + 512], vectors).astype(np.float32)
        every[at : at + 512] = block
        block = block.copy()
        block[np.arange(len(block)), np.arange(at, at + len(block))] = np.inf
        some = np.argpartition(block, near - 1, axis=1)[:, :near]
        order = np.argsort(np.take_along_axis(block, some, 1), axis=1, kind="stable")
        first[at : at + 512] = np.take_along_axis(some, order, 1)
    out = diverse(every, first, min(links, near))
    a = np.concatenate([np.repeat(np.arange(size), out.shape[1]), out.ravel()])
    b = np.concatenate([out.ravel(), np.repeat(np.arange(size), out.shape[1])])
    pairs = np.unique(a * size + b)
    a, b = pairs // size, pairs % size
    order = np.lexsort((every[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    width = 2 * links
    graph = np.full((size, width + 1), -1, np.int32)
    room = place < width
    graph[a[room], place[room]] = b[room]
    return bridged(graph, every)


def bridged(graph: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Chain the parts that a walk from the first node misses, by columns added at the end."""
    size = len(graph)
    reached = np.zeros(size, bool)
    fresh = np.array([0])
    while True:
        while len(fresh):
            reached[fresh] = True
            ahead = np.unique(graph[fresh])
            ahead = ahead[ahead >= 0]
            fresh = ahead[~reached[ahead]]
        missed = np.flatnonzero(~reached)
        if not len(missed):
            return graph
        there = np.flatnonzero(reached)
        target = missed[0]
        source = there[every[target, there].argmin()]
        free = np.flatnonzero(graph[source] < 0)
        if not len(free):
            graph = np.concatenate([graph, np.full((size, 4), -1, np.int32)], axis=1)
            free = np.flatnonzero(graph[source] < 0)
        graph[source, free[0]] = target
        fresh = np.array([target])


def build(vectors: np.ndarray, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the lowest up as (nodes, neighbours); upper ones hold every links-th node."""
    nodes, levels = np.arange(len(vectors)), []
    while True:
        links = settings.links * (2 if not levels else 1)
        graph = level_graph(vectors[nodes], links, settings.near)
        levels.append((nodes.astype(np.int32), np.where(graph >= 0, nodes[graph], -1).astype(np.int32)))
        if len(nodes) <= settings.links:
            return levels
        nodes = nodes[:: settings.links]


def search(
    vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """(distances squared, nodes) that a beam search finds for every query, nearest first."""
    start = np.zeros((len(asked), 1), np.int32)
    for nodes, graph in reversed(levels[1:]):
        at = np.full(len(vectors), -1, np.int32)
        at[nodes] = np.arange(len(nodes))
        _, start = walk(vectors, at, graph, asked, start, max(1, beam // 4))
    nodes, graph = levels[0]
    return walk(vectors, nodes, graph, asked, start, beam)


def walk(vectors, at, graph, asked, start, beam):
    """Beam search on one level for all queries at once, from the nodes in start (-1 for none);
    ``at`` gives a node's row in the graph."""
    size = len(asked)
    seen = np.zeros((size, len(vectors)), bool)
    best = np.full((size, beam), np.inf, np.float32)
    found = np.full((size, beam), -1, np.int32)
    done = np.ones((size, beam), bool)
    rows, cols = np.nonzero(start >= 0)
    best[rows, cols] = ((vectors[start[rows, cols]] - asked[rows]) ** 2).sum(1)
    found[rows, cols], done[rows, cols] = start[rows, cols], False
    seen[rows, start[rows, cols]] = True
    active = np.arange(size)
    while True:
        open_ = np.where(done[active], np.inf, best[active])
        step = open_.argmin(1)
        live = np.isfinite(open_[np.arange(len(active)), step])
        active, step = active[live], step[live]
        if not len(active):
            return best, found
        done[active, step] = True
        ahead = graph[at[found[active, step]]]
        fresh = (ahead >= 0) & ~seen[active[:, None], ahead]
        rows, cols = np.nonzero(fresh)
        nodes = ahead[rows, cols]
        seen[active[rows], nodes] = True
        new = np.full(ahead.shape, np.inf, np.float32)
        new[rows, cols] = ((vectors[nodes] - asked[active[rows]]) ** 2).sum(1)
        all_best = np.concatenate([best[active], new], 1)
        order = np.argpartition(all_best, beam - 1, axis=1)[:, :beam]
        order = np.take_along_axis(
            order, np.argsort(np.take_along_axis(all_best, order, 1), axis=1), 1
        )
        best[active] = np.take_along_axis(all_best, order, 1)
        found[active] = np.take_along_axis(np.concatenate([found[active], ahead], 1), order, 1)
        done[active] = np.take_along_axis(
            np.concatenate([done[active], ~np.isfinite(new)], 1), order, 1
        )


def graphs(vectors: DataFrame, settings: Settings) -> DataFrame:
    """One row per shard: node vectors, the ids of each node and its graph, as flat arrays.

    vectors is (vec_id, embedding). Of equal vectors the k + 1 smallest ids are kept, all that a
    result can hold.
    """
    named = vectors.withColumns(
        {"h": F.xxhash64("embedding"), "g": F.hash("embedding"), "dim": F.size("embedding")}
    )
    first = Window.partitionBy("h", "g", "dim").orderBy("vec_id")
    nodes = saved(
        named.select("vec_id", "h", "g", "dim", "embedding")
        .distinct()
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= settings.k + 1)
        .groupBy("h", "g", "dim")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("v"))
    )
    shards = nodes.groupBy("dim").agg(
        F.ceil(F.count("*") / settings.shard_rows).cast("int").alias("shards")
    )
    dealt = nodes.join(shards, "dim").withColumn(
        "shard", F.pmod(F.col("h"), F.col("shards")).cast("int")
    )

    def run(batches):
        for table, cuts in runs(batches, ["dim", "shard"]):
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(start, end - start).combine_chunks()
                matrix = np.stack(part["v"].to_numpy()).astype(np.float64)
                levels = build(fitted(matrix, *frame(matrix)), settings)
                ids = part["ids"].combine_chunks()
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "dim": part["dim"][0].as_py(),
                            "shard": part["shard"][0].as_py(),
                            "matrix": matrix.tobytes(),
                            "ids": ids.to_pylist(),
                            "levels": [
                                {"nodes": n.tobytes(), "width": g.shape[1], "links": g.tobytes()}
                                for n, g in levels
                            ],
                        }
                    ],
                    schema=pa.schema(
                        [
                            ("dim", pa.int32()),
                            ("shard", pa.int32()),
                            ("matrix", pa.binary()),
                            ("ids", pa.list_(pa.list_(pa.int64()))),
                            (
                                "levels",
                                pa.list_(
                                    pa.struct(
                                        [
                                            ("nodes", pa.binary()),
                                            ("width", pa.int32()),
                                            ("links", pa.binary()),
                                        ]
                                    )
                                ),
                            ),
                        ]
                    ),
                )

    return (
        dealt.select("dim", "shard", "h", "g", "ids", "v")
        .repartition("dim", "shard")
        .sortWithinPartitions("dim", "shard", "h", "g")
        .select("dim", "shard", "ids", "v")
        .mapInArrow(
            run,
            "dim int, shard int, matrix binary, ids array<array<long>>,"
            " levels array<struct<nodes: binary, width: int, links: binary>>",
        )
    )


def blocks(queries: DataFrame, settings: Settings) -> DataFrame:
    """Queries as rows of a block each: (dim, block, asked)."""
    sized = queries.withColumn("dim", F.size("embedding"))
    counts = sized.groupBy("dim").agg(F.count("*").alias("n"))
    number = F.pmod(
        F.xxhash64("vec_id"), F.ceil(F.col("n") / settings.query_block)
    ).cast("int")
    return (
        sized.join(counts, "dim")
        .groupBy("dim", number.alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "embedding")).alias("asked"))
    )


def neighbours(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors found for every query.

    Both tables are (vec_id, embedding). score is the Euclidean distance in double precision;
    ties go to the smaller vec_id. A row is no candidate of a query with its own id. Vectors that
    are null or zero or hold null or non-finite components take no part, nor do rows without an
    id; vectors of different lengths have no distance. Repeated rows count once. Fewer candidates
    than k give fewer rows.
    """

    def valid(rows: DataFrame) -> DataFrame:
        return rows.select("vec_id", "embedding").where(
            F.col("vec_id").isNotNull() & usable(F.col("embedding"))
        )

    built = saved(graphs(valid(vectors), settings))
    asked = blocks(valid(queries).distinct(), settings)
    shards = built.select("dim", "shard")
    sent = asked.join(shards, "dim")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from answered(row, settings)

    found = sent.join(built, ["dim", "shard"]).mapInArrow(
        run, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= settings.k)
        .select("query_id", "rank", "vec_id", "score")
    )


def answered(row: dict, settings: Settings):
    """The k best of one shard for every query of a block."""
    matrix = np.frombuffer(row["matrix"]).reshape(-1, row["dim"])
    levels = [
        (
            np.frombuffer(x["nodes"], np.int32),
            np.frombuffer(x["links"], np.int32).reshape(-1, x["width"]),
        )
        for x in row["levels"]
    ]
    asked = np.array([q["embedding"] for q in row["asked"]], np.float64)
    at = frame(matrix)
    _, found = search(fitted(matrix, *at), levels, fitted(asked, *at), settings.beam)
    out = []
    for query, vector, nodes in zip(row["asked"], asked, found, strict=True):
        nodes = nodes[nodes >= 0]
        score = np.sqrt(((matrix[nodes] - vector) ** 2).sum(1))
        best = sorted(
            (float(s), i)
            for s, n in zip(score, nodes, strict=True)
            for i in row["ids"][n]
            if i != query["vec_id"]
        )
        out += [(query["vec_id"], i, s) for s, i in best[: settings.k]]
    if out:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2] for x in out], pa.float64()),
            ],
            ["query_id", "vec_id", "score"],
        )
