from paceline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_prefixes_go(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "<|end|> bye"),
        (3, 0, "user", "hi"),
        (4, 5, "user", "hi"), (4, 7, "assistant", "hello"), (4, 9, "user", "<|end|> bye"),
        (5, 0, "user", "other"), (5, 0, "user", "other"),
        (6, None, None, None), (6, 1, "user", ""),
        (7, 0, "user", "hi"), (7, 1, "assistant", "hello!"),
        (None, 0, "user", "lost"),
    ]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_turns", "'x' as copies")
    found = {r.conv_id: r for r in chat.formatted(turns).collect()}
    assert {k: (r.n_turns, r.copies) for k, r in found.items()} == {
        2: (3, 2), 5: (1, 1), 6: (2, 1), 7: (2, 1),
    }
    assert found[2].chat == (
        "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\n<|end|>\n<|user|>\n< |end|> bye\n<|end|>\n"
    )
    assert found[6].chat == "<|unknown|>\n\n<|end|>\n<|user|>\n\n<|end|>\n"


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
