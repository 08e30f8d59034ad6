import numpy as np
import pytest

from paceline.llm import near_join
from paceline.llm.components import components
from paceline.llm.words import shingles, word_hashes

from .data import SCHEMA, documents


def brute(rows, size=5, threshold=0.8):
    """Per row its class and links, from all pairs."""
    sets = []
    for r in rows:
        words = "".join(c if c.isalnum() else " " for c in (r[1] or "").lower()).split()
        runs = range(max(1, len(words) - size + 1)) if words else ()
        sets.append({tuple(words[i : i + size]) for i in runs})
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common / (len(sets[a]) + len(sets[b]) - common) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[top(a)] = top(b)
    members = {}
    for k, r in enumerate(rows):
        members.setdefault(top(k), []).append(r[0])
    least = {k: min((i for i in m if i is not None), default=None) for k, m in members.items()}
    return [(r[0], least[top(k)], links[k]) for k, r in enumerate(rows)]


def keyed(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("block", [3, 256])
def test_all_pairs(spark, block):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumnRenamed("n_chars", "class_id")
    found = near_join.near_join(docs, near_join.Settings(block=block))
    assert found.columns == ["doc_id", "class_id", "n_links"]
    assert keyed(tuple(r) for r in found.collect()) == keyed(brute(rows))


def test_near_copies_at_the_threshold(spark):
    """Pairs just above and just below 0.8 in a larger group of one text."""
    base = [f"w{i}" for i in range(104)]
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        words = list(base)
        for at in range(k % 4 + 1):
            words[5 + 20 * at + k % 3] = f"x{k}"
        rows.append((k, " ".join(words)))
    found = near_join.near_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert keyed(tuple(r) for r in found.collect()) == keyed(brute(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_join.near_join(docs).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Ein langer Text, über 20 Wörter? " * 9
    whole = shingles(text), word_hashes(text)
    monkeypatch.setattr("paceline.llm.words.PIECE", 11)
    assert np.array_equal(whole[0], shingles(text)) and np.array_equal(whole[1], word_hashes(text))


def test_recall_decides_the_depth():
    settings = near_join.Settings()
    assert settings.depth_for(0.95) == settings.depth > settings.depth_for(0.8)
    assert settings.found(0.8, settings.depth_for(0.8)) >= settings.recall


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (7, 7)], "a int, b int")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 31)}, 50: 40}


def apart(settings):
    """Two texts above the threshold that share no path of full length."""
    flips, factors = near_join.permutations(settings)
    for k in range(1000):
        base = [f"a{k}w{i}" for i in range(104)]
        other = base[:30] + ["x"] + base[31:70] + ["y"] + base[71:]
        both = [near_join.signature(shingles(" ".join(x)), flips, factors) for x in (base, other)]
        same = (both[0] == both[1]).reshape(settings.trees, settings.depth)
        if not same.all(1).any():
            return " ".join(base), " ".join(other)


def test_pairs_at_the_threshold_among_closer_ones(spark):
    """Other rows do not decide how short the prefixes get."""
    close = " ".join(f"c{i}" for i in range(300))
    rows = [(0, close), (1, close + " end"), *enumerate(apart(near_join.Settings()), 2)]
    found = near_join.near_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert keyed(tuple(r) for r in found.collect()) == keyed(brute(rows))


def test_repeated_rows_with_a_near_neighbour(spark):
    words = [f"w{i}" for i in range(104)]
    text, near = " ".join(words), " ".join([*words[:50], "x", *words[51:]])
    rows = [(1, text)] * 7 + [(1, text.upper()), (2, near), (None, near), (None, near), (3, text)]
    found = near_join.near_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert keyed(tuple(r) for r in found.collect()) == keyed(brute(rows))
