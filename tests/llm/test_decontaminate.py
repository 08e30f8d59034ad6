import hashlib
import re

import pytest

from paceline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "What is the Capital of France, and why is it Paris today?"),
    (2, "Über short item"),
    (3, None), (4, "!!"), (5, "one"), (None, "a nameless item"),
    (6, "the capital of france and why is it paris today or not"),
    (2, "second part of item two"), (7, "over over over over over over over over over over over"),
]
TEXTS = [
    (1, "x " * 500 + "So: what IS the capital--of France and why is it Paris? y"),
    (2, "WHAT is the capital of France and why is it"),
    (3, "Über SHORT item; über short items"),
    (4, "über short item"),
    (5, "One. stone one-two"),
    (6, "over " * 25),
    (7, None), (8, ""), (9, "...\n"), (10, "a nameless\titem"), (11, "second part of item two"),
    (None, "one"), (5, "One. stone one-two"), (12, "İ one ß"),
]


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer(lower)]


def brute(text, items, size=10):
    own, hit, found = words(text), set(), set()
    plain = [w[0] for w in own]
    for item, line in items:
        parts = [w[0] for w in words(line)]
        for i in range(max(1, len(parts) - size + 1)) if parts else ():
            window = parts[i : i + size]
            for at in range(len(plain) - len(window) + 1):
                if plain[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add("" if item is None else str(item))
    spans = []
    for k in sorted(hit):
        if k - 1 in hit:
            spans[-1] = (spans[-1][0], own[k][2])
        else:
            spans.append((own[k][1], own[k][2]))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), spans


def test_hits_and_spans(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as spans")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.contamination(docs.repartition(3), items).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, [tuple(s) for s in r.spans]) for r in rows]
    assert sorted(got, key=str) == sorted(((d, *brute(t, ITEMS)) for d, t in TEXTS), key=str)
    assert all(r.contaminated == (r.n_hit > 0) for r in rows)
    clean = decontaminate.clean(docs, items)
    assert clean.columns == ["doc_id", "text", "spans"]
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted(
        (d for d, t in TEXTS if not brute(t, ITEMS)[1]), key=str
    )


def test_empty_tables(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r.contaminated for r in none)
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(TEXTS)


@pytest.mark.parametrize("max_bytes", [60, 250])
def test_a_benchmark_in_parts(spark, max_bytes):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    owned, parts = decontaminate.dealt_windows(items, 10, max_bytes)
    assert parts > 1 and owned.select("window").distinct().count() == owned.count()
    whole = decontaminate.contamination(docs, items).collect()
    found = decontaminate.contamination(docs, items, max_bytes=max_bytes).collect()
    assert sorted(map(str, found)) == sorted(map(str, whole))
    kept = decontaminate.clean(docs, items, max_bytes=max_bytes).collect()
    assert sorted(map(str, kept)) == sorted(map(str, decontaminate.clean(docs, items).collect()))
