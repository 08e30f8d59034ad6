"""Removal of byte strings that an earlier document has, by prefix-free parsing.

A rolling hash triggers wherever it is smallest within a window of positions; every string of the
looked-for length then has exactly one trigger of its own, at the same place wherever the string
stands. Strings that follow one another with one trigger form a phrase, which overlaps the next
one by a string less a byte, so each string is in one phrase and no phrase is a prefix of another.

The dictionary holds every distinct phrase with the first document that has it: a phrase of a
later document goes as a whole. Phrases that differ can still share strings, but only if the
bytes around their triggers agree; those few, of which each is looked at in its first document
only, are ordered by their strings. Together this is the order of all strings in the corpus, as
far as it tells the first document of each.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.words import mixed, range_hashes
from paceline.session import saved

U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    """length: bytes of a string. roll: bytes under the rolling hash. window: positions of which
    one triggers, so that all strings of a phrase share ``length - window + 1`` bytes. buckets:
    parts of the dictionary for each shuffle partition, so that one part fits into a task."""

    length: int = 50
    roll: int = 8
    window: int = 26
    buckets: int = 4
    chunk: int = 8 << 20
    piece: int = 1 << 20

    @property
    def core(self) -> int:
        return self.length - self.window + 1


def sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    step = 1
    while 2 * step <= window:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = window - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def phrases(data: bytes, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, end of the strings, trigger) of each phrase of a document, in order."""
    strings = len(data) - settings.length + 1
    found = []
    for at in range(0, max(0, strings), settings.piece):
        size = min(settings.piece, strings - at)
        part = np.frombuffer(data, np.uint8, size + settings.length - 1, at)
        count = size + settings.window - 1
        rolled = np.ndarray((count,), "<u8", part.tobytes(), strides=(1,))
        keys = (rolled * U64(0x9E3779B97F4A7C15)) ^ (rolled >> U64(29))
        keys = (keys * U64(0xBF58476D1CE4E5B9)) >> U64(32) << U64(32)
        keys |= np.arange(count, dtype=U64)
        triggers = (sliding_min(keys, settings.window) & U64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(triggers, prepend=-1))
        found.append((first + at, np.append(first[1:], size) + at, triggers[first] + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def parsed(data: bytes, settings: Settings):
    """Phrases of a document: first strings, ends, hash of the shared bytes, hash of the phrase."""
    first, end, trigger = phrases(data, settings)
    values = np.frombuffer(data, np.uint8)
    if not len(first):
        none = np.zeros(0, U64)
        return first, end, none, none
    return (
        first,
        end,
        range_hashes(values, trigger, trigger + settings.core) >> U64(16),
        range_hashes(values, first, end + settings.length - 1) >> U64(16),
    )


def keyed(core: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """One hash for a phrase inside a document."""
    return mixed((core << U64(16)) ^ phrase)


ITEM = np.dtype([("high", "<u8"), ("low", "<u4")])  # 48 bits of the core, 48 of the phrase
SENT = pa.schema(
    [
        ("bucket", pa.int32()),
        ("docs", pa.binary()),
        ("counts", pa.binary()),
        ("items", pa.binary()),
        ("doc_id", pa.int64()),
        ("whole", pa.binary()),
    ]
)
SENT_SQL = "bucket int, docs binary, counts binary, items binary, doc_id long, whole binary"


def packed(bucket: np.ndarray, doc: np.ndarray, items: np.ndarray):
    """A row for each bucket, its items in order of documents."""
    order = np.lexsort((doc, bucket))
    bucket, doc, items = bucket[order], doc[order], items[order]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        docs, counts = np.unique(doc[start:end], return_counts=True)
        yield {
            "bucket": int(bucket[start]),
            "docs": docs.tobytes(),
            "counts": counts.astype(np.uint32).tobytes(),
            "items": items[start:end].tobytes(),
        }


def by_doc(doc: np.ndarray, values: np.ndarray, name: str):
    """A row for each document with its values."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    cuts = np.append(np.flatnonzero(np.diff(doc, prepend=doc[0] - 1)), len(doc)) if len(doc) else []
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield {"doc_id": int(doc[start]), name: np.unique(values[start:end]).tobytes()}


def first_of(keys: list[np.ndarray], doc: np.ndarray):
    """Order by keys and document; for each place the first document of its key."""
    order = np.lexsort((doc, *reversed(keys)))
    new = np.zeros(len(doc), bool)
    if len(doc):
        new[0] = True
        for key in keys:
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
    first = doc[order][new][np.cumsum(new) - 1] if len(doc) else doc
    return order, new, first


def rows_of(rows, schema: pa.Schema, size: int = 2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def sent_phrases(docs: DataFrame, buckets: int, settings: Settings) -> DataFrame:
    """Phrases by bucket of the dictionary, each once per chunk of documents, with its first one.

    Phrases of the other documents of a chunk are repeats already; they are passed on as such.
    """

    def flush(held):
        ids = np.concatenate([np.full(len(c), d, np.int64) for d, c, _ in held])
        core = np.concatenate([c for _, c, _ in held])
        phrase = np.concatenate([p for _, _, p in held])
        order, new, first = first_of([core, phrase], ids)
        core, phrase, ids = core[order], phrase[order], ids[order]
        items = np.empty(int(new.sum()), ITEM)
        items["high"] = (core[new] << U64(16)) | (phrase[new] >> U64(32))
        items["low"] = phrase[new] & U64(0xFFFFFFFF)
        bucket = (mixed(core[new]) % U64(buckets)).astype(np.int32)
        yield from packed(bucket, ids[new], items)
        late = ids > first
        for row in by_doc(ids[late], keyed(core[late], phrase[late]), "whole"):
            yield row | {"bucket": row["doc_id"] % buckets}

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if doc is None or len(data) < settings.length:
                    continue
                _, _, core, phrase = parsed(data, settings)
                held.append((doc, core, phrase))
                size += len(data)
                if size >= settings.chunk:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(lambda batches: rows_of(rows(batches), SENT), SENT_SQL)


def bucketed(batches):
    """(bucket, documents, items as bytes) of whole buckets, and rows that are passed on."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["items"] is None:
                yield None, row, None
                continue
            if row["bucket"] != now and held:
                yield now, *joined(held)
                held = []
            now = row["bucket"]
            held.append((row["docs"], row["counts"], row["items"]))
    if held:
        yield now, *joined(held)


def joined(held):
    docs = [
        np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)) for d, c, _ in held
    ]
    return np.concatenate(docs), b"".join(x for _, _, x in held)


FOUND = pa.schema([("doc_id", pa.int64()), ("whole", pa.binary()), ("part", pa.binary())])
FOUND_SQL = "doc_id long, whole binary, part binary"


def dictionary(sent: DataFrame) -> DataFrame:
    """Per document, in rows for each bucket, hashes of phrases.

    whole: phrases that an earlier document has too. part: phrases first seen here whose shared
    bytes also stand in other phrases, first seen in another document.
    """

    def rows(batches):
        for bucket, doc, raw in bucketed(batches):
            if bucket is None:
                yield {"doc_id": doc["doc_id"], "whole": doc["whole"]}
                continue
            items = np.frombuffer(raw, ITEM)
            core = items["high"] >> U64(16)
            phrase = ((items["high"] & U64(0xFFFF)) << U64(32)) | items["low"]
            order, new, first = first_of([core, phrase], doc)
            core, phrase, doc = core[order], phrase[order], doc[order]
            late = doc > first
            yield from by_doc(doc[late], keyed(core[late], phrase[late]), "whole")
            core, phrase, doc = core[new], phrase[new], doc[new]
            start = np.flatnonzero(np.diff(core, prepend=core[0] ^ U64(1)))
            group = np.cumsum(np.isin(np.arange(len(core)), start)) - 1
            mixed_first = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            shared = mixed_first[group]
            yield from by_doc(doc[shared], keyed(core[shared], phrase[shared]), "part")

    return (
        sent.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lambda batches: rows_of(rows(batches), FOUND), FOUND_SQL)
    )


def strings_of(data: bytes, first: np.ndarray, end: np.ndarray, settings: Settings):
    """Starts and hashes of all strings of some phrases."""
    sizes = end - first
    starts = np.repeat(first - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    values = np.frombuffer(data, np.uint8)
    return starts, range_hashes(values, starts, starts + settings.length)


def sent_strings(docs: DataFrame, buckets: int, settings: Settings) -> DataFrame:
    """Strings of the phrases in ``part`` by bucket; docs is (doc_id, text, whole, part)."""

    def flush(held):
        ids = np.concatenate([np.full(len(h), d, np.int64) for d, h in held])
        hashes = np.concatenate([h for _, h in held])
        yield from packed((hashes % U64(buckets)).astype(np.int32), ids, hashes)

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for doc, text, _, part in zip(
                *(batch.column(i).to_pylist() for i in range(4)), strict=True
            ):
                if not part:
                    continue
                data = (text or "").encode("utf-8", "surrogatepass")
                first, end, core, phrase = parsed(data, settings)
                asked = np.isin(keyed(core, phrase), np.frombuffer(b"".join(part), U64))
                _, hashes = strings_of(data, first[asked], end[asked], settings)
                held.append((doc, np.unique(hashes)))
                size += len(hashes)
                if size >= settings.chunk // 8:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(lambda batches: rows_of(rows(batches), SENT), SENT_SQL)


def late_strings(sent: DataFrame) -> DataFrame:
    """Per document the hashes of strings that an earlier document has."""

    def rows(batches):
        for _, doc, raw in bucketed(batches):
            hashes = np.frombuffer(raw, U64)
            order, _, first = first_of([hashes], doc)
            late = doc[order] > first
            yield from by_doc(doc[order][late], hashes[order][late], "part")

    return (
        sent.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lambda batches: rows_of(rows(batches), FOUND), FOUND_SQL)
    )


def removed(data: bytes, whole: list[bytes], strings: list[bytes], settings: Settings):
    """Maximal runs of bytes to remove, as arrays of starts and ends."""
    first, end, core, phrase = parsed(data, settings)
    gone = np.isin(keyed(core, phrase), np.frombuffer(b"".join(whole), U64))
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, first[gone], 1)
    np.add.at(edges, end[gone] + settings.length - 1, -1)
    if strings:
        starts, hashes = strings_of(data, first[~gone], end[~gone], settings)
        starts = starts[np.isin(hashes, np.frombuffer(b"".join(strings), U64))]
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + settings.length, -1)
    covered = np.diff((np.cumsum(edges[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(covered > 0), np.flatnonzero(covered < 0)


def cut(docs: DataFrame, settings: Settings) -> DataFrame:
    """Apply what was found; docs is (doc_id, text, whole, part, strings)."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = {"n_bytes": [], "kept": [], "spans": []}
            columns = (batch.column(i).to_pylist() for i in (1, 2, 4))
            for text, whole, strings in zip(*columns, strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                starts, ends = [], []
                if whole or strings:
                    starts, ends = removed(data, whole or [], strings or [], settings)
                out["n_bytes"].append(len(data))
                borders = zip([0, *ends], [*starts, len(data)], strict=True)
                out["kept"].append(b"".join(data[a:b] for a, b in borders))
                out["spans"].append(
                    [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends, strict=True)]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(out["n_bytes"], pa.int64()),
                    pa.array(out["kept"], pa.binary()),
                    pa.array(out["spans"], spans),
                ],
                ["doc_id", "n_bytes", "kept", "spans"],
            )

    return docs.mapInArrow(
        run, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>"
    )


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, kept and spans of every row of docs (doc_id, text).

    A byte goes if it is in a string of ``length`` bytes that also starts in a document with a
    smaller doc_id; texts count as UTF-8, a null one as empty. kept has the other bytes, spans the
    removed ones as maximal runs. Strings do not cross documents, and rows that share a doc_id do
    not remove anything from each other. A row without an id keeps all and takes nothing.
    """
    spark = docs.sparkSession
    buckets = settings.buckets * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = saved(dictionary(sent_phrases(docs, buckets, settings)))
    gathered = found.groupBy("doc_id").agg(
        F.collect_list("whole").alias("whole"), F.collect_list("part").alias("part")
    )
    # The texts are shuffled once: both uses below share the exchange.
    told = docs.join(gathered.hint("shuffle_hash"), "doc_id", "left")
    strings = (
        late_strings(sent_strings(told, buckets, settings))
        .groupBy("doc_id")
        .agg(F.collect_list("part").alias("strings"))
    )
    return cut(told.join(strings.hint("shuffle_hash"), "doc_id", "left"), settings)
