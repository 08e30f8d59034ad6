import hashlib

import corpus_pipeline
from paceline.llm import langid
from paceline.llm.queries import QUERIES

from .data import SCHEMA, documents
from .test_decontaminate import brute as benchmark_hits
from .test_near_join import brute as similar
from .test_secrets import wanted as secret_spans

ITEM = "which of the rivers is it that the house by the cloud was for"


def tables(spark, folder):
    rows = documents()
    rows += [(400, f"Nun, {ITEM}? Genau.", "en", "src0", 3), (401, "the token = abcdef123456 is on it", "en", "src0", 3)]
    # One id with two texts, of which the second stands for a near copy too.
    first, second = ([w for r in rows[k : k + 4] for w in (r[1] or "").split()][::-1] for k in (10, 20))
    rows += [(402, " ".join(first), "en", "src0", 3), (402, " ".join(second), "en", "src1", 3)]
    rows += [(403, " ".join([*second, "again"]), "en", "src1", 3)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string")
    items.write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def redacted(text):
    out, at = "", 0
    for start, _, _, end in secret_spans(text)[1]:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_against_plain_python(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    labelled = []
    for r in rows:
        langs, scores = langid.score_batch([r[1]], model)
        if langs[0] != "und" and scores[0] >= corpus_pipeline.SURE:
            labelled.append((r[0], r[1], langs[0], *r[3:]))
    keys = [(r[0], hashlib.md5(r[1].encode()).hexdigest()) for r in labelled]
    numbers = {key: n for n, key in enumerate(sorted({k for k in keys if k[0] is not None}))}
    kept = [r for r in labelled if r[0] is None]
    named = {numbers[k]: r for k, r in zip(keys, labelled, strict=True) if k in numbers}
    named = [(n, *r[1:]) for n, r in named.items()]
    for (n, *_), (_, least, _) in zip(named, similar(named), strict=True):
        if n == least:
            kept.append(next(r for k, r in zip(keys, labelled, strict=True) if numbers.get(k) == n))
    assert sum(r[0] == 402 for r in kept) == 2 and not any(r[0] == 403 for r in kept)
    clean = [r for r in kept if not benchmark_hits(r[1], [(1, ITEM)])[1]]
    wanted = [(r[0], redacted(r[1]), r[2], r[3], len(redacted(r[1]))) for r in clean]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[:5]) for r in found), key=str) == sorted(wanted, key=str)
    assert 400 not in {r.doc_id for r in found} and "[SECRET]" in {r.doc_id: r.text for r in found}[401]
    assert all(r.rate >= 0 and r.copies >= 0 for r in found)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        docs = out


def test_columns_beside_those_of_documents_pass_through(spark, tmp_path):
    """Under names that operators use for their results or inside."""
    rows = tables(spark, tmp_path)
    names = ["lang_pred", "score", "_rank", "fp", "sig", "class_id", "base", "secrets", "others", "_words", "rate", "a.b"]
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    named = plain.selectExpr("*", *(f"concat('{n}', doc_id) as `{n}`" for n in names))
    assert named.count() == len(rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        last = k == len(corpus_pipeline.STAGES) - 1
        out = stage(spark, named, str(tmp_path))
        left = [n for n in names if not (last and n == "rate")]
        assert out.columns[: 5 + len(left)] == [*plain.columns, *left]
        found = out.collect()
        assert all(r.doc_id is None or r[n] == f"{n}{r.doc_id}" for r in found for n in left)
        same = stage(spark, plain, str(tmp_path))
        want = sorted(str((r.doc_id, r.text, r.lang)) for r in same.collect())
        assert sorted(str((r.doc_id, r.text, r.lang)) for r in found) == want


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
