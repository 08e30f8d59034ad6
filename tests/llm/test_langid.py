import zlib

import numpy as np
import pytest

from paceline.llm import langid

from .data import SCHEMA, documents


def fold(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def hashed(text, bits):
    """Buckets of the n-grams of a text, one at a time."""
    if not any(c.isalpha() for c in text):
        return []
    plain = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in plain:
        plain = plain.replace("  ", " ")
    out = []
    for n, factors in enumerate(langid.FACTORS, 1):
        for i in range(len(plain) - n + 1):
            h = sum(ord(plain[i + k]) * f for k, f in enumerate(factors)) % 2**32
            h ^= h >> 15
            out.append((h * 0x2C1B3C6D % 2**32) >> (32 - bits))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


def test_counts_and_scores_match_plain_python(spark, docs):
    settings = langid.Settings(bits=10)
    model = langid.train(docs.where(~langid.held_out()), settings)
    rows = [r for r in documents() if not fold(r[0]) and r[1] is not None and r[2] is not None]
    assert model.languages == tuple(sorted({r[2] for r in rows}))
    for k, lang in enumerate(model.languages):
        counts = np.full(1 << 10, settings.smoothing)
        for r in rows:
            if r[2] == lang:
                np.add.at(counts, hashed(r[1], 10), 1)
        assert np.allclose(model.log_prob[:, k], np.log(counts / counts.sum()), atol=1e-4)
    found = {(r.doc_id, r.text): r for r in langid.predict(docs, model).collect()}
    for r in documents():
        got, buckets = found[r[0], r[1]], hashed(r[1] or "", 10)
        if not buckets:
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        totals = model.log_prior + model.log_prob[buckets].astype(float).sum(0)
        chances = np.exp(totals - totals.max())
        assert got.lang_pred == model.languages[totals.argmax()]
        assert abs(got.score - 1 / chances.sum()) < 1e-6


def test_held_out_accuracy(spark):
    """On held-out prose of one language, so without the documents that hold the passage."""
    docs = spark.createDataFrame(documents(seed=2, n=400), SCHEMA).where("doc_id < 400")
    model = langid.train(docs.where(~langid.held_out()))
    rows = langid.predict(docs.where(langid.held_out()), model).collect()
    rows = [r for r in rows if r.doc_id % 9 and len(r.text.split()) > 5]
    assert len(rows) > 25 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_pieces_do_not_change_a_text():
    whole, cut = langid.Settings(), langid.Settings(chunk=7)
    for text in ("Über 12 die Straße, schön!", "a1b 2c", "   x   yz  ", "İstanbul ŞŞ 9"):
        assert sorted(np.concatenate(list(langid.grams(text, whole)))) == sorted(
            np.concatenate(list(langid.grams(text, cut)))
        )


def test_empty_tables_and_clashing_columns(spark, docs):
    model = langid.train(docs.limit(0))
    clashing = docs.selectExpr("doc_id", "text", "lang as lang_pred", "1 as score")
    rows = langid.predict(clashing, model)
    assert rows.columns == ["doc_id", "text", "lang_pred", "score"]
    assert {(r.lang_pred, r.score) for r in rows.collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.train(docs, langid.Settings(max_languages=1))
