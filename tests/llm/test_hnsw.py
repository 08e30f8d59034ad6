import numpy as np
import pytest

from paceline.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n=900, dim=12):
    """Clusters, many equal vectors, and rows that take no part."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, dim)) * 3
    out = []
    for i in range(n):
        vector = centres[i % 9] + rng.normal(size=dim)
        if i % 4 == 0:
            vector = centres[0]
        out.append((i, [float(np.float32(x)) for x in vector], i % 9))
    odd = [None, [], [0.0] * dim, [1.0, None] * (dim // 2), [float("nan")] * dim, [float("inf")] * dim]
    out += [(n + k, v, 0) for k, v in enumerate(odd)] + [(None, [1.0] * dim, 0), (2000, [1.0, 2.0], 0)]
    return [*out, out[3], out[100]]


def exact(queries, every, k=10):
    out = {}
    for q, v in queries.items():
        near = sorted(
            (float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i)
            for i, w in every.items()
            if i != q and len(w) == len(v)
        )
        out[q] = near[:k]
    return out


def usable(data):
    return {
        i: v for i, v, _ in data
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v)
    }


def test_recall_and_scores(spark):
    data = rows()
    vectors = spark.createDataFrame(data, SCHEMA).repartition(3)
    settings = hnsw.Settings(shard_rows=150, query_block=8)
    found = hnsw.neighbours(vectors, vectors.where("vec_id % 20 = 0"), settings).collect()
    every = usable(data)
    wanted = exact({i: v for i, v in every.items() if i % 20 == 0}, every)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == {q for q, near in wanted.items() if near}
    hits = sum(len({i for _, i in got[q]} & {i for _, i in wanted[q]}) for q in got)
    assert hits >= 0.98 * sum(map(len, wanted.values()))
    for q, near in got.items():
        assert near == sorted(near)
        for score, i in near:
            direct = np.sqrt(((np.array(every[i]) - np.array(every[q])) ** 2).sum())
            assert abs(score - direct) <= 1e-12
    # equal vectors: ties go to the smaller id
    assert [i for _, i in got[0]] == [4, 8, 12, 16, 20, 24, 28, 32, 36, 40]


@pytest.mark.parametrize("factor, offset", [(1e20, 0.0), (1e-24, 0.0), (0.1, 1000.0), (1e-3, -5e4)])
def test_recall_at_any_scale(spark, factor, offset):
    rng = np.random.default_rng(7)
    matrix = rng.normal(size=(1200, 24)) * factor + offset
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(matrix)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    settings = hnsw.Settings(shard_rows=500)
    found = hnsw.neighbours(vectors, vectors.where("vec_id % 20 = 0"), settings).collect()
    every = {i: v for i, v, _ in data}
    wanted = exact({i: v for i, v in every.items() if i % 20 == 0}, every)
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got[q]) == 10 for q in wanted)
    hits = sum(len(got[q] & {i for _, i in near}) for q, near in wanted.items())
    assert hits >= 0.9 * 10 * len(wanted)


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 1.0], 0), (1, [1.0, 2.0], 0), (2, [4.0, 1.0], 0)], SCHEMA)
    found = hnsw.neighbours(few, few.where("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [
        (1, 1, 1.0), (2, 2, 3.0),
    ]
    assert hnsw.neighbours(few.limit(0), few.limit(0)).count() == 0
    assert hnsw.neighbours(few, few.limit(0)).count() == 0


def test_every_node_can_be_reached():
    rng = np.random.default_rng(1)
    far = np.concatenate([rng.normal(size=(40, 4)) + 100 * k for k in range(6)]).astype(np.float32)
    graph = hnsw.level_graph(far, 4, 8)
    reached, fresh = {0}, [0]
    while fresh:
        fresh = [int(x) for x in {*graph[fresh].ravel()} - reached if x >= 0]
        reached.update(fresh)
    assert len(reached) == len(far)
