import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paceline.llm import sharding
from paceline.llm.sharding import Shard, Slots, equal_shards
from tests.llm import data


def expected(key, shards):
    def bid(s):
        h = int(hashlib.md5(f"{key}:{s.number}".encode()).hexdigest()[:13], 16)
        return -s.weight / math.log((h + 0.5) / 16**13), -s.number

    return max(shards, key=bid).number


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents(spark):
    rows = data.documents()
    docs = spark.createDataFrame(rows, data.SCHEMA).repartition(3)
    found = sharding.document_shards(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    for r in found:
        key = "null" if r.doc_id is None else r.doc_id
        assert r.law == "key" and r.shard == expected(key, equal_shards(16))
        assert r.grown_shard == expected(key, equal_shards(17)) and r.grown_shard in (r.shard, 16)
    gapless(found)
    assert sharding.document_shards(docs.limit(0)).count() == 0


def test_the_result_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(data.documents(), data.SCHEMA)
    one, many = (
        sorted(map(tuple, sharding.document_shards(docs.repartition(n)).collect()), key=repr) for n in (1, 7)
    )
    assert one == many


def test_weights_and_changes_of_the_set(spark):
    keys = spark.range(4000).withColumnRenamed("id", "k")
    shards = (Shard(0, 1.0), Shard(1, 3.0), Shard(7, 0.0), Shard(9, 4.0))
    lost = shards[:1] + shards[2:]
    rows = sharding.sharded(keys, ["k"], shards, lost).collect()
    held = Counter(r.shard for r in rows)
    assert set(held) == {0, 1, 9}
    assert abs(held[0] / 4000 - 1 / 8) < 0.03 and abs(held[9] / 4000 - 1 / 2) < 0.03
    assert all(r.grown_shard == r.shard for r in rows if r.shard != 1)
    assert all(r.shard == expected(r.k, shards[:2] + shards[3:]) for r in rows)
    gapless(rows)


def test_a_key_and_a_row_that_fill_a_third(spark):
    rows = [(1, "hot", None, 5)] * 300 + [(1, f"v{i}", 2, 6) for i in range(200)]
    rows += [(i % 50, f"w{i}", 1, 7) for i in range(300)] + [(None, None, None, None)] * 3
    frame = spark.createDataFrame(rows, "id long, v string, slot int, `a.b` int").repartition(4)
    out = sharding.sharded(frame, ["id"], equal_shards(4), slots=Slots(digits=1, copies=7))
    assert out.columns == ["id", "v", "a.b", "shard", "slot"]
    got = out.collect()
    assert Counter((r.id, r.v, r["a.b"]) for r in got) == Counter((i, v, n) for i, v, _, n in rows)
    assert all(r.shard == expected("null" if r.id is None else r.id, equal_shards(4)) for r in got)
    gapless(got)


def test_keys_of_several_columns_and_long_texts(spark):
    rows = [(None, "a"), ("a", None), ("x" * 200_000, "b"), ("", ""), ("", "")]
    frame = spark.createDataFrame(rows, "p string, q string")
    got = sharding.sharded(frame, ["p", "q"], equal_shards(3)).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.p == ""}) == 1
    gapless(got)


def test_no_python_and_no_cross_join(spark):
    docs = spark.createDataFrame(data.documents(), data.SCHEMA)
    plan = sharding.document_shards(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "BroadcastNestedLoop"))


def test_written_shards(spark, tmp_path):
    frame = spark.range(500).withColumn("t", F.col("id").cast("string"))
    sharding.write_shards(sharding.sharded(frame, ["id"], equal_shards(4)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and len(list((tmp_path / "out").glob("shard=*"))) == 4


def test_shards_are_checked():
    for bad in ([], [Shard(1, 0.0)], [Shard(1), Shard(1, 2.0)]):
        with pytest.raises(ValueError):
            sharding.winner(F.lit("k"), bad)
