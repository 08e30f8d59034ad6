"""Benchmark decontamination with one Aho-Corasick automaton over the windows of all items.

Words are the runs of ASCII letters, digits and non-ASCII characters, ASCII letters compared in
lower case. A window is ``size`` consecutive words of an item; a shorter item with at least one
word is one window. Texts are scanned once; windows match whole words only. A benchmark whose
windows are too many for one automaton is dealt into parts, and the texts are scanned once a part.
"""

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import saved

#: A word in a text as it was written, in either case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes that stand outside words become spaces, A-Z become a-z.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)


def joined(text: str | None) -> str:
    """The words of a text with one space before, between and after, a character for each byte."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split(b" ")
    return (b" " + b"".join(w + b" " for w in words if w)).decode("latin-1")


def windows(text: str | None, size: int) -> Iterator[str]:
    """The windows of an item, each with a space at either end; repeated ones come again."""
    words = joined(text).split(" ")[1:-1]
    for i in range(max(1, len(words) - size + 1)) if words else ():
        yield " " + " ".join(words[i : i + size]) + " "


@dataclass(frozen=True)
class Automaton:
    """The automaton of all windows: each gives its number of words and the items it occurs in."""

    matcher: ahocorasick.Automaton
    items: tuple[tuple[str, ...], ...]

    @classmethod
    def of(cls, owners: Iterable[tuple[str, Iterable[str]]]) -> "Automaton":
        """From pairs of a window and the ids of its items, each window once."""
        matcher, items = ahocorasick.Automaton(), []
        for window, ids in owners:
            matcher.add_word(window, (window.count(" ") - 1, len(items)))
            items.append(tuple(ids))
        if items:
            matcher.make_automaton()
        return cls(matcher, tuple(items))

    def hit(self, text: str | None) -> bool:
        """Whether any window occurs."""
        return bool(self.items) and any(True for _ in self.matcher.iter(joined(text)))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit runs of words (end exclusive), items with occurring windows."""
        line = joined(text)
        n_words, runs, found = line.count(" ") - 1, [], set()
        if not self.items or not n_words:
            return max(0, n_words), runs, found
        matches = list(self.matcher.iter(line))
        if matches:
            spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            last = np.searchsorted(spaces, [end for end, _ in matches])
            spans = [
                (int(end) - words, int(end)) for end, (_, (words, _)) in zip(last, matches, strict=True)
            ]
            runs = merged(spans)
            for window in {i for _, (_, i) in matches}:
                found.update(self.items[window])
        return n_words, runs, found


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of words that are covered by spans."""
    runs: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, end))
    return runs


def dealt_windows(items: DataFrame, size: int, max_bytes: int) -> tuple[DataFrame, int]:
    """The distinct windows of the items (item_id, text), as (part, window, items), and the number
    of parts. A part has about ``max_bytes`` of windows and ids. Null texts have no windows; rows
    that share an item_id are one item, a null id is "".
    """

    def run(batches):
        for batch in batches:
            held: list[tuple[str, str]] = []
            for item, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                for window in windows(text, size):
                    held.append((window, item or ""))
                    if len(held) == 10_000:
                        yield listed(held)
                        held = []
            if held:
                yield listed(held)

    def listed(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["window", "item"]
        )

    found = items.select(F.col("item_id").cast("string"), "text")
    owned = saved(
        found.mapInArrow(run, "window string, item string")
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    weight = F.octet_length("window") + F.octet_length(F.array_join("items", ","))
    total = owned.agg(F.sum(weight)).first()[0] or 0
    parts = max(1, -(-total // max_bytes))
    return owned.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts))), parts


def automata(items: DataFrame, size: int, max_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The broadcast automaton of each part of the benchmark, and whether it is the last one.

    An automaton takes some fifty times the bytes of its windows. One is made at a time, and freed
    when the next one is asked for.
    """
    owned, parts = dealt_windows(items, size, max_bytes)
    context = items.sparkSession.sparkContext
    for k in range(parts):
        rows = owned.where(F.col("part") == k).select("window", "items").collect()
        shared = context.broadcast(Automaton.of((r["window"], r["items"]) for r in rows))
        yield shared, k == parts - 1
        if k < parts - 1:
            shared.unpersist()


#: Bytes of windows in one automaton.
MAX_BYTES = 4 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPANS_SQL = "array<struct<start: long, end: long>>"


def pairs(spans: list[dict]) -> list[tuple[int, int]]:
    return [(s["start"], s["end"]) for s in spans]


def structs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": s, "end": e} for s, e in spans]


def scanned(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """rows (doc_id, text, runs, found) with what one automaton finds added to runs and found."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            runs, found = [], []
            for text, old, ids in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                _, fresh, more = shared.value.scan(text)
                runs.append(structs(merged([*pairs(old), *fresh])))
                found.append(sorted({*ids, *more}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(runs, SPANS),
                    pa.array(found, pa.list_(pa.string())),
                ],
                names,
            )

    return rows.mapInArrow(run, rows.schema)


def contamination(
    docs: DataFrame, items: DataFrame, size: int = 10, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """One row per row of docs (doc_id, text): words, hit words, items and hit spans of the text.

    spans holds the hit passages as start and end (exclusive) in code points of the original
    text. A null text has no words, a repeated row gives a row again, and without items nothing
    is hit. items_sha256 is taken of the sorted item ids joined by commas, a null id as "".
    A benchmark of more than ``max_bytes`` of windows takes several passes, with a written table
    in between.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    for shared, last in automata(items, size, max_bytes):
        if last:
            break
        if len(rows.columns) == 2:
            rows = rows.withColumns(
                {"runs": F.array().cast(SPANS_SQL), "found": F.array().cast("array<string>")}
            )
        rows = saved(scanned(rows, shared))

    def scan(batches):
        for batch in batches:
            out = {"n_words": [], "n_hit": [], "n_items": [], "items_sha256": [], "spans": []}
            before = (batch.column(i).to_pylist() for i in range(2, batch.num_columns))
            before = list(zip(*before, strict=True)) or [([], [])] * batch.num_rows
            for text, (old, ids) in zip(batch.column(1).to_pylist(), before, strict=True):
                n_words, runs, found = shared.value.scan(text)
                if old:
                    runs, found = merged([*pairs(old), *runs]), found | set(ids)
                out["n_words"].append(n_words)
                out["n_hit"].append(sum(end - start for start, end in runs))
                out["n_items"].append(len(found))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
                out["spans"].append(structs(original(text, runs)) if runs else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(out["n_words"], pa.int64()),
                    pa.array(out["n_hit"], pa.int64()),
                    pa.array(out["n_items"], pa.int64()),
                    pa.array(out["items_sha256"], pa.string()),
                    pa.array([n > 0 for n in out["n_hit"]], pa.bool_()),
                    pa.array(out["spans"], SPANS),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return rows.mapInArrow(
        scan,
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string,"
        f" contaminated boolean, spans {SPANS_SQL}",
    )


def clean(
    docs: DataFrame, items: DataFrame, size: int = 10, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs.

    Passes as for :func:`contamination`; each one takes what the one before kept.
    """
    at = docs.columns.index("text")

    def without(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def keep(batches):
            for batch in batches:
                texts = batch.column(at).to_pylist()
                yield batch.filter(pa.array([not shared.value.hit(t) for t in texts], pa.bool_()))

        return rows.mapInArrow(keep, rows.schema)

    for shared, last in automata(items, size, max_bytes):
        docs = without(docs, shared) if last else saved(without(docs, shared))
    return docs


def original(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as ranges of the text they were read from."""
    spans, words = [], enumerate(WORD.finditer(text))
    for first, end in runs:
        match = next(m for i, m in words if i == first)
        start = match.start()
        if end - 1 > first:
            match = next(m for i, m in words if i == end - 1)
        spans.append((start, match.end()))
    return spans
