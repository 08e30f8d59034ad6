import random

import pytest

from paceline.llm import repeats

from .data import SCHEMA, documents


def brute(rows, length):
    seen, out = {}, []
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for doc, data in texts:
        for x in range(len(data) - length + 1):
            if doc is not None:
                string = data[x : x + length]
                seen[string] = min(doc, seen.get(string, doc))
    for doc, data in texts:
        gone = bytearray(len(data))
        for x in range(len(data) - length + 1):
            if doc is not None and seen[data[x : x + length]] < doc:
                gone[x : x + length] = b"\1" * length
        spans = [k for k in range(len(data)) if gone[k] and not (k and gone[k - 1])]
        out.append((doc, len(data), bytes(b for b, g in zip(data, gone, strict=True) if not g), len(spans)))
    return sorted(out, key=str)


def found(docs, settings=repeats.Settings()):
    rows = repeats.without_repeats(docs, settings).collect()
    for r in rows:
        assert r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)
    return sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in rows), key=str)


def test_documents(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumnRenamed("source", "kept")
    assert found(docs) == brute(rows, 50)


@pytest.mark.parametrize("piece,chunk", [(1 << 20, 8 << 20), (37, 200)])
def test_few_letters_and_runs(spark, piece, chunk):
    """Texts where strings overlap themselves and share parts of phrases."""
    rng = random.Random(3)
    parts = ["a" * 70, "ab" * 40, "é" * 30, "xyz" * 20]
    parts += ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(40):
        text = "".join(rng.choice(parts)[rng.randrange(9) :] for _ in range(rng.randrange(5)))
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs, repeats.Settings(piece=piece, chunk=chunk)) == brute(rows, 50)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without_repeats(docs).count() == 0
