import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import negatives
from paceline.llm.negatives import Settings

SCHEMA = "vec_id long, embedding array<double>, label int"
SMALL = Settings(block_rows=40, sample=300, fanout=4, block_queries=16)


def rows(scale=1.0, offset=0.0, n=600, dim=6):
    """Clusters, many equal vectors, and rows that take no part."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, dim)) * 3
    out = []
    for i in range(n):
        v = centres[i % 8] + rng.normal(size=dim) * 0.4
        if i % 3 == 0:
            v = centres[0]  # a third of all rows are one vector
        out.append((i, [float(x * scale + offset) for x in v], int(rng.integers(0, 4))))
    odd = [None, [None] * dim, [float("nan")] * dim, [float("inf")] * dim, [1e306] * dim]
    out += [(n + k, v, 1) for k, v in enumerate(odd)]
    out += [(n + 10, [1.0] * dim, None), (None, [1.0] * dim, 1), (n + 20, [1.0, 2.0], 1), (n + 30, [], 2)]
    out += [(0, out[0][1], 3), (20, out[21][1], 2), out[5], out[5], (40, out[40][1], out[40][2])]
    return out


def exact(data, anchors):
    every = set()
    for i, v, label in data:
        if i is not None and v is not None and label is not None and all(
            x is not None and math.isfinite(x * 256) for x in v
        ):
            every.add((i, label, tuple(math.floor(x * 256) if abs(x) < 1e15 else int(x * 256) for x in v)))
    out = []
    for a in every:
        if not anchors(a[0]):
            continue
        near = sorted(
            (-score, b[0], b != a, b[1])
            for b in every
            if len(b[2]) == len(a[2]) and abs(score := sum(map(lambda x, y: x * y, a[2], b[2]))) < 2**63
        )
        kin = [(-s, i) for s, i, other, label in near if label == a[1] and other][:5]
        for p, positive in kin:
            fits = [(-s, i) for s, i, _, label in near if label != a[1] and 80 * p <= -100 * s <= 100 * p]
            out += [(a[0], positive, k + 1, i, p, s) for k, (s, i) in enumerate(fits[:5])]
    return sorted(out)


def found(spark, data, settings, parts=4):
    items = spark.createDataFrame(data, SCHEMA).repartition(parts).where(negatives.usable(F.col("embedding")))
    items = items.select("vec_id", "label", negatives.whole_numbers(F.col("embedding")).alias("vector"))
    out = negatives.hard_negatives(items, items.where("vec_id % 20 = 0"), settings)
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-3, 0.0), (1.0, 1000.0), (-3e5, 7e5)])
def test_equals_brute_force(spark, scale, offset):
    data = rows(scale, offset)
    wanted = exact(data, lambda i: i % 20 == 0)
    assert wanted and found(spark, data, SMALL) == wanted


def test_huge_components(spark):
    data = rows(n=60) + [(100, [3e15] + [0.5] * 5, 1), (120, [1e20] * 6, 1), (121, [1e-3] * 6, 1), (122, [2e-3] * 6, 2)]
    assert found(spark, data, SMALL) == exact(data, lambda i: i % 20 == 0)


def test_few_rows_and_none(spark):
    data = [(0, [1.0, 1.0], 1), (20, [1.0, 2.0], 1), (3, [1.0, 1.0], 2)]
    assert found(spark, data, Settings()) == exact(data, lambda i: i % 20 == 0)
    assert found(spark, [], Settings()) == []
    assert found(spark, [(1, [1.0], 1)], Settings()) == []


def test_ranges_eliminate_whole_leaves():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 8)) * 1000
    data = np.floor(np.concatenate([c + rng.normal(size=(100, 8)) * 5 for c in centres]))
    tree = negatives.grown(rng.permutation(data), len(data), Settings(block_rows=100, fanout=4))
    cells = negatives.placed(tree, data, ranges=True)
    asked = data[:40]
    scores = asked @ data.T
    bound = np.sort(scores, axis=1)[:, -6]
    low, high = np.floor(0.95 * bound)[:, None], bound[:, None]
    kept = [(q, cell) for index, cell in negatives.survivors(tree, asked, low, high) for q in index]
    needed = {(q, cells[x]) for q in range(40) for x in np.flatnonzero((scores[q] >= low[q]) & (scores[q] <= high[q]))}
    assert needed <= set(kept)
    assert len(kept) < 0.6 * 40 * len(set(cells))


def test_survivors_hold_every_score():
    """Random windows over random vectors: nothing inside a window is eliminated."""
    rng = np.random.default_rng(8)
    for scale in (1, 1e4, 1e18):
        data = np.floor(rng.normal(size=(800, 5)) * rng.choice([1, 40], size=(800, 1)) * 256 * scale)
        tree = negatives.grown(data[:300], len(data), Settings(block_rows=30, fanout=4))
        cells = negatives.placed(tree, data, ranges=True)
        scores = data[:50] @ data.T
        picked = np.take_along_axis(scores, rng.integers(0, 800, size=(50, 2)), 1)
        low, high = np.minimum(picked, 0.8 * picked), np.maximum(picked, 0.8 * picked)
        kept = {(q, c) for index, c in negatives.survivors(tree, data[:50], low, high) for q in index}
        for q in range(50):
            inside = ((scores[q][:, None] >= low[q]) & (scores[q][:, None] <= high[q])).any(1)
            assert {(q, c) for c in cells[inside]} <= kept
