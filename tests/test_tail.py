"""The source of growing files: every line once, in order, whatever the splits and restarts."""

import random

import pytest

from paceline.sources.tail import BITS, LineReader, tail_lines
from paceline.sources.writers import to_files


def read(reader, start, end):
    batches = (b for p in reader.partitions(start, end) for b in reader.read(p))
    return [(r["arr"], r["value"]) for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_splits_of_any_size(tmp_path, split):
    rng = random.Random(split)
    wanted = []
    for number in (3, 20, 100):  # in the order of numbers, not of names
        lines = ["x" * rng.choice([0, 1, 5, 40]) + "ä" * rng.randrange(3) for _ in range(60)]
        raw, at = "\n".join(lines).encode(), 0
        (tmp_path / f"log-{number}.jsonl").write_bytes(raw if number < 100 else raw + b"\nhalf")
        for k, line in enumerate(lines):
            if line or k < 59:
                wanted.append(((number << BITS) + at, line))
            at += len(line.encode()) + 1
    (tmp_path / "_hidden").write_text("no")
    reader = LineReader(str(tmp_path), split)
    end = reader.latestOffset()
    assert end["file"] == 100 and read(reader, reader.initialOffset(), end) == wanted
    with (tmp_path / "log-100.jsonl").open("a") as file:
        file.write(" line\n")
    assert [v for _, v in read(reader, end, reader.latestOffset())] == ["half line"]


def test_long_lines_and_empty_folders(tmp_path):
    reader = LineReader(str(tmp_path), 1000)
    assert reader.latestOffset() == reader.initialOffset()
    text = "y" * 3_000_000
    (tmp_path / "1").write_text(f"a\n{text}\nb\n")
    assert [v for _, v in read(reader, reader.initialOffset(), reader.latestOffset())] == ["a", text, "b"]
    (tmp_path / "named").write_text("")
    with pytest.raises(ValueError):
        reader.latestOffset()


def test_a_restart_continues_at_the_right_line(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in").mkdir()

    def run():
        lines = tail_lines(spark, source, split=16)
        to_files(lines, out, log).trigger(availableNow=True).start().awaitTermination()
        return [r.value for r in spark.read.parquet(out).orderBy("arr").collect()]

    (tmp_path / "in" / "0001").write_text("one\ntwo\nthr")
    assert run() == ["one", "two"]
    with (tmp_path / "in" / "0001").open("a") as file:
        file.write("ee\nfour")  # a file that another one follows is complete
    (tmp_path / "in" / "0002").write_text("five\n\nsix\nsev")
    assert run() == ["one", "two", "three", "four", "five", "", "six"]
    assert run() == ["one", "two", "three", "four", "five", "", "six"]
