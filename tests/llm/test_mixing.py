import math
import random

import pytest

from paceline.llm import mixing

KINDS = {"good": "river cloud tree".split(), "poor": "buy now cheap".split(), "toxic": "scum trash vile".split()}
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tables(spark):
    rng, docs, labels = random.Random(8), [], []
    for i in range(240):
        kind = rng.choices(list(KINDS), [6, 3, 1])[0]
        words = [rng.choice(KINDS[kind] + ["the", "of", "a"]) for _ in range(rng.randrange(1, 60))]
        docs.append((i, " ".join(words).capitalize() + "."))
        if i % 3 == 0:
            labels.append((i, int(kind == "good"), int(kind == "toxic")))
    docs += [(300, None), (301, ""), (302, "..."), (None, "river tree"), docs[0], (303, "new words")]
    labels += [(0, None, 0), (None, 1, 0), (1, 1, None), (999, 1, 0), labels[0]]
    return (
        spark.createDataFrame(docs, SCHEMA).repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        docs,
    )


def expected(rows, domain):
    return sum(r.n_tokens * r.rate * r[f"p_{domain}"] for r in rows)


def test_targets_are_met(spark, tables):
    docs, labels, every = tables
    settings = mixing.Settings(targets={"good": 0.5, "poor": 0.4, "toxic": 0.1}, buckets=512)
    rows = mixing.rates(docs.selectExpr("*", "1 as rate"), labels, settings).collect()
    assert len(rows) == len(every)
    total = sum(r.n_tokens for r in rows)
    for domain, share in settings.targets.items():
        assert abs(expected(rows, domain) - share * total) < 1e-3 * total
    for r in rows:
        assert r.rate >= 0 and math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1
        assert abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9
    assert {r.n_tokens for r in rows if r.doc_id in (300, 301, 302)} == {0}
    right = sum(
        max(KINDS, key=lambda k: r[f"p_{k}"])
        == next((k for k, w in KINDS.items() if any(x in (t or "").lower() for x in w)), "good")
        for r, t in ((r, dict(every)[r.doc_id]) for r in rows)
        if r.doc_id is not None and r.doc_id < 240 and r.n_tokens > 8
    )
    assert right >= 0.95 * sum(r.doc_id is not None and r.doc_id < 240 and r.n_tokens > 8 for r in rows)


def test_posteriors_match_plain_python(spark, tables):
    docs, labels, _ = tables
    settings = mixing.Settings(buckets=64)
    model = mixing.learn(docs, mixing.domain_of_labels(labels), settings)
    rows = docs.select("doc_id", "text", mixing.tokens(docs["text"], 64).alias("w")).collect()
    scored = {
        (r.doc_id, r.text): r.domains
        for r in mixing.with_posteriors(docs, model, settings).collect()
    }
    for r in rows:
        sums = [p + sum(w[b] for b in r.w) for p, w in zip(model.prior, model.weights, strict=True)]
        odds = [math.exp(s - max(sums)) for s in sums]
        for got, x in zip(scored[r.doc_id, r.text], odds, strict=True):
            assert abs(got - x / sum(odds)) < 1e-9


def test_unreachable_targets_stay_at_the_bound(spark, tables):
    docs, labels, _ = tables
    rows = mixing.rates(docs, labels, mixing.Settings(targets={"poor": 1.0}, buckets=512)).collect()
    assert min(r.rate for r in rows) == 0 and expected(rows, "poor") > 10 * expected(rows, "good")


def test_without_labels_or_documents(spark, tables):
    docs, labels, every = tables
    rows = mixing.rates(docs, labels.limit(0)).collect()
    assert len(rows) == len(every) and {(r.rate, r.copies) for r in rows} == {(1.0, 1)}
    assert mixing.rates(docs.limit(0), labels).count() == 0


def test_columns_that_share_names_with_inner_ones(spark, tables):
    docs, labels, every = tables
    settings = mixing.Settings(buckets=64)
    named = docs.selectExpr("*", "doc_id as _words", "-doc_id as _scores", "'x' as rate")
    rows = mixing.mixed_documents(named, labels, settings).collect()
    assert len(rows) == len(every) and all(r.rate >= 0 for r in rows)
    assert all(r.doc_id is None or (r["_words"], r["_scores"]) == (r.doc_id, -r.doc_id) for r in rows)
