"""Wire formats, label maps, registry logs and metric trees."""

import json

from pyspark.sql import functions as F

from paceline.functions.text import full_match, is_blank, scope_path
from paceline.functions.times import format_click_time, parse_click_time
from paceline.operators.ingest import parse_messages, split_rejects
from paceline.operators.registry import (
    current_metrics, first_labels, header_map, snapshot_messages, split_scopes,
)
from paceline.operators.tree import build_tree, flatten_tree, split_clashes, split_trees
from paceline.sources.readers import decode_clicks, decode_diagnostics, job_config_from_properties
from paceline.sources.writers import encode_click, encode_diagnostics


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def envelope(job="Testjob", attempt="attempt-01", tree=None, flag=True, ts=1_700_000_000_000):
    header = {"<job_id>": attempt, "<tm_id>": "tm-01"}
    if job is not None:
        header["<job_name>"] = job
    tree = {"taskmanager": {"Status": {"JVM": {"CPU": {"Load": "0.1"}}}}} if tree is None else tree
    return json.dumps(
        {"metricHeader": header, "metricsSnapshot": tree, "autoScalingEnabled": flag, "timestamp": ts}
    )


def cpu(load):
    return {"taskmanager": {"Status": {"JVM": {"CPU": {"Load": load, "Time": "-1.0"}}}}}


def parsed(spark, *texts, **options):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "arr bigint, value string")
    return parse_messages(decode_diagnostics(rows), **options).orderBy("arr").collect()


def test_diagnostics_variants(spark):
    rows = parsed(
        spark,
        envelope(),
        envelope(tree={"jobmanager": {"Status": {}}}),
        envelope(tree={"taskmanager": {"Status": {"JVM": {}}}}),
        envelope(tree=cpu("NaN")),
        envelope(tree=cpu("-1.0")),
        envelope(tree={"taskmanager": None}),
        envelope(flag=False),
    )
    assert [r.reason for r in rows] == [None] * 7
    assert [r.is_worker for r in rows] == [True, False, True, True, True, True, True]
    assert rows[0].load == 0.1 and rows[1].load is None and rows[2].load == 0.0
    assert rows[3].load != rows[3].load and rows[4].load == -1.0 and rows[5].load == 0.0
    assert [r.enabled for r in rows][-1] is False
    first = rows[0]
    assert (first.job_id, first.attempt_id, first.container) == ("Testjob", "attempt-01", "tm-01")


def test_diagnostics_rejects(spark):
    rows = parsed(
        spark,
        "{broken",
        "",
        envelope(job=None),
        envelope(attempt=""),
        envelope(attempt=None),
        envelope(tree=cpu("abc")),
        envelope(tree={"taskmanager": {"Status": {"JVM": {"CPU": {}}}}}),
        envelope(tree={"jobmanager": cpu("abc")}),
    )
    assert [r.reason for r in rows] == [
        "malformed", "malformed", "no job id", "no attempt id", "no attempt id",
        "unreadable load", "unreadable load", None,
    ]
    skipped = parsed(spark, envelope(tree={"taskmanager": {}}), skip_missing=True)
    assert skipped[0].load is None and skipped[0].reason is None


def test_encode_then_decode_gives_the_same(spark):
    texts = [envelope(), envelope(tree=cpu("1")), envelope(attempt='q"\\\n')]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "arr bigint, value string")
    decoded = decode_diagnostics(rows)
    again = decoded.orderBy("arr").select(encode_diagnostics(F.to_json("metricsSnapshot"))).collect()
    assert [json.loads(r.value) for r in again] == [json.loads(t) for t in texts]


def test_click_times_lose_the_half_of_the_day(spark):
    text = format_click_time(F.expr("timestamp'2024-02-01 13:02:03.456'"))
    row = one(spark, text.alias("t"), parse_click_time(text).cast("string").alias("p"))
    assert row.t == "01-02-2024 01:02:03:456" and row.p == "2024-02-01 01:02:03.456"
    noon = parse_click_time(format_click_time(F.expr("timestamp'2024-02-01 12:02:00'")))
    assert one(spark, noon.cast("string").alias("p")).p == "2024-02-01 00:02:00"
    iso = parse_click_time(F.lit("2024-02-01T13:02:03.456Z"), None).cast("string")
    assert one(spark, iso.alias("p")).p == "2024-02-01 13:02:03.456"


def test_click_lines(spark):
    lines = spark.createDataFrame(
        [('{"timestamp":"01-02-2024 01:02:03:456","page":"/help"}',), ("oops",),
         ('{"timestamp":"yesterday","page":"/help"}',)], "value string"
    )
    good, bad = decode_clicks(lines)
    assert [r.page for r in good.collect()] == ["/help"] and bad.count() == 2
    again = good.select(encode_click()).first().value
    assert again == '{"timestamp":"01-02-2024 01:02:03:456","page":"/help"}'


def test_text_functions(spark):
    row = one(
        spark,
        full_match(F.lit("my-test-job"), ".*test.*").alias("a"),
        full_match(F.lit("job"), "").alias("b"),
        full_match(F.lit(""), "").alias("c"),
        full_match(F.lit("ab\n"), "ab").alias("d"),
        is_blank(F.lit(None).cast("string")).alias("e"),
        scope_path(F.lit("a.b c..d-e..")).alias("f"),
        scope_path(F.lit("...")).alias("g"),
        scope_path(F.lit(".a")).alias("h"),
    )
    assert list(row) == [True, False, True, False, True, ["a", "b_c", "", "d_e"], [], ["", "a"]]


def test_labels_keep_the_first_value(spark):
    rows = [(3, "p", "x", "late"), (1, "p", "x", "first"), (2, "p", "y", "1"), (4, "p", "y", "1")]
    labels = spark.createDataFrame(rows, "seq bigint, process string, label string, value string")
    found = {r.label: (r.value, r.conflict) for r in first_labels(labels, ["process"]).collect()}
    assert found == {"x": ("first", True), "y": ("1", False)}
    assert header_map(labels, ["process"]).first().metricHeader == {"x": "first", "y": "1"}


LOG = "seq bigint, process string, scope string, name string, kind string, value double, op string"


def test_registry_to_message(spark):
    log = spark.createDataFrame(
        [
            (1, "p", "taskmanager.Status", "n", "counter", 0.0, "add"),
            (2, "p", "taskmanager.Status", "n", "counter", 1.0, "add"),
            (3, "p", "taskmanager.Status", "g", "gauge", 0.5, "add"),
            (4, "p", "taskmanager.gone", "g", "gauge", 10.1, "add"),
            (5, "p", "taskmanager.gone", "g", "gauge", 10.1, "remove"),
            (6, "p", "taskmanager.Status", "h", "histogram", 3.0, "add"),
            (7, "p", "", "lost", "counter", 3.0, "add"),
            (8, "p", "taskmanager", "n", "gauge", 2.0, "add"),
        ],
        LOG,
    )
    usable, rejected = split_scopes(log)
    assert [r.name for r in rejected.collect()] == ["lost"]
    assert current_metrics(usable, ["process"]).count() == 4
    labels = spark.createDataFrame(
        [(1, "p", "<tm_id>", "t")], "seq bigint, process string, label string, value string"
    )
    made = snapshot_messages(log, labels, ["process"], F.lit(5)).select(encode_diagnostics()).first()
    assert json.loads(made.value) == {
        "metricHeader": {"<tm_id>": "t"},
        "metricsSnapshot": {
            "taskmanager": {"Status": {"n": "1.0", "g": "0.5"}, "gone": {}, "n": "2.0"}
        },
        "autoScalingEnabled": True,
        "timestamp": 5,
    }


def test_trees_survive_the_way_there_and_back(spark):
    trees = [
        {"a": {"b.c": {"x": "1", "y": None}, "e": {}}, "z": '{q"}'},
        {},
        {"p": {"q": {"r": {"s": "v"}, "a": "1"}, "b": "x\ny"}, "pp": "1", "p.q": {"k": "é"}},
        {"one": {"two": {"three": {"four": {"five": {"six": "deep"}}}}}, "": {"": ""}},
    ]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "id int, t string")
    leaves = flatten_tree(rows, "t", ["id"], empty_groups=True)
    built = build_tree(leaves, ["id"]).orderBy("id").collect()
    assert [json.loads(r.tree) for r in built] == trees
    named = flatten_tree(rows, "t", ["id"]).filter("id = 0").collect()
    assert {(tuple(r.path), r.name, r.value) for r in named} == {
        (("a", "b.c"), "x", "1"), (("a", "b.c"), "y", None), ((), "z", '{q"}'),
    }


def test_job_config_from_properties(spark):
    rows = spark.createDataFrame(
        [("j", "job.autoscaling.container.memory.mb", "1024"),
         ("j", "job.autoscaling.container.num.cores", "4"),
         ("j", "job.autoscaling.container.count", "1")], "job_id string, key string, value string"
    )
    assert list(job_config_from_properties(rows).first()) == ["j", 1024, 4, 1]


def test_split_rejects_parts_the_rows(spark):
    rows = spark.createDataFrame([(0, envelope()), (1, "no")], "arr bigint, value string")
    good, bad = split_rejects(parse_messages(decode_diagnostics(rows)))
    assert [r.arr for r in good.collect()] == [0] and [r.arr for r in bad.collect()] == [1]


def test_deep_trees_and_rejects(spark):
    """No depth is too deep, and what cannot be read comes out with a reason."""
    deep = {"v": "end"}
    for k in range(25):
        deep = {f"g{k}": deep}
    texts = [json.dumps(deep), '{"a":"1"}', "[1]", '"x"', "", None, '{"a":', '{"a":1,"a":2}', "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    good, bad = split_trees(rows, "t")
    assert {r.id: r.reason for r in bad.collect()} == {
        2: "no object", 3: "no object", 4: "no object", 5: "missing", 6: "malformed",
        7: "duplicate key",
    }
    leaves = flatten_tree(good, "t", ["id"]).collect()
    assert {(r.id, len(r.path), r.name, r.value) for r in leaves} == {(0, 25, "v", "end"), (1, 0, "a", "1")}
    shallow = flatten_tree(good.filter("id = 0"), "t", ["id"], depth=2).first()
    assert len(shallow.path) == 1 and json.loads(shallow.value) == deep["g24"]["g23"]


def test_texts_that_a_recursion_would_not_survive(spark):
    """Long strings, deep trees and endless braces in one table; the plan stays as it is for flat ones."""
    chain = '{"g":' * 990 + '{"v":"end"}' + "}" * 990
    texts = [
        json.dumps({"a": "x" * 1_000_000}), json.dumps({"a": '\\"{' * 300_000}), chain, "{" * 10_000,
        '{"g":' * 1200 + "1" + "}" * 1200, json.dumps({f"k{i}": {"v": i} for i in range(20_000)}),
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    good, bad = split_trees(rows, "t")
    assert {r.id: r.reason for r in bad.collect()} == {3: "malformed", 4: "malformed"}
    leaves = flatten_tree(rows, "t", ["id"])
    got = leaves.filter("id < 5").collect()
    assert {(r.id, len(r.path), r.name, len(r.value)) for r in got} == {
        (0, 0, "a", 1_000_000), (1, 0, "a", 900_000), (2, 990, "v", 3),
    }
    assert leaves.filter("id = 5").count() == 20_000
    flat = flatten_tree(good.filter("id < 2"), "t", ["id"])
    assert leaves._jdf.queryExecution().logical().toString().count("\n") == (
        flat._jdf.queryExecution().logical().toString().count("\n")
    )


def test_a_group_wins_over_a_metric_of_its_name(spark):
    leaves = spark.createDataFrame(
        [(1, ["A"], "B", "1"), (1, ["A", "B"], "c", "2"), (1, ["A"], "BB", "3"), (1, ["A"], "x", "4"),
         (1, ["A"], "x", "5"), (1, [], "A", "6"), (2, ["A"], "B", "7"), (3, ["g"], None, None), (3, [], "g", "8")],
        "id int, path array<string>, name string, value string",
    )
    kept, rejected = split_clashes(leaves, ["id"])
    assert {r.value for r in rejected.collect()} == {"1", "4", "6", "8"} and kept.count() == 5
    built = {r.id: r.tree for r in build_tree(leaves, ["id"]).collect()}
    assert built == {1: '{"A":{"B":{"c":"2"},"BB":"3","x":"5"}}', 2: '{"A":{"B":"7"}}', 3: '{"g":{}}'}


def test_trees_are_dealt_over_all_tasks_and_sorted_once(spark):
    """Adaptive execution must not merge tasks of leaves, and clashes and text come from one order."""
    rows = [(k, ["g", "h"], n, v) for k in range(64) for n, v in (("a", "1"), ("a", "2"), ("b", None), (None, None))]
    rows += [(None, ["g"], None, None), (None, ["g"], None, None), (None, ["g"], "x", "1"), (None, [], "g", "0")]
    set_before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        leaves = spark.createDataFrame(rows, "id int, path array<string>, name string, value string")
        built = build_tree(leaves, ["id"])
        assert str(built._jdf.queryExecution().executedPlan()).count("Sort [") == 1
        for frame in built, split_clashes(leaves, ["id"])[0]:
            assert frame.rdd.getNumPartitions() == 16
        trees = {r.id: r.tree for r in built.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", set_before)
    assert trees == {None: '{"g":{"x":"1"}}'} | {k: '{"g":{"h":{"a":"2","b":null}}}' for k in range(64)}
