"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters that are no letters counts as one space, and
n-grams of one to three characters are hashed into a fixed number of buckets.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.session import saved

UNKNOWN = "und"
#: Multipliers of the characters of an n-gram, one row for each n.
FACTORS = (
    (0x9E3779B1,),
    (0x85EBCA6B, 0xC2B2AE35),
    (0x27D4EB2F, 0x165667B1, 0xD3A2646D),
)
_tables: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Settings:
    """bits: binary log of the number of buckets. smoothing: added to every count.

    max_languages bounds the broadcast matrix (languages x buckets floats); more raise.
    """

    bits: int = 15
    smoothing: float = 0.5
    max_languages: int = 1000
    chunk: int = 1 << 19


@dataclass(frozen=True)
class Model:
    """log_prob: a row for each bucket, a column for each language, in order of their names."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray
    settings: Settings = field(default_factory=Settings)


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool)
    return _tables["letters"]


def pieces(text: str, size: int) -> Iterator[np.ndarray]:
    """Normalised code points of a text, in pieces that overlap by what n-grams need.

    Nothing comes out if the text has no letter.
    """
    letters, last = _letters(), np.full(1, 32, np.uint32)
    found = False
    for at in range(0, len(text), size):
        part = text[at : at + size].lower().encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(part, "<u4")
        is_letter = letters[codes]
        if not is_letter.any():
            continue
        found = True
        codes = np.concatenate([last, np.where(is_letter, codes, np.uint32(32))])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        yield codes
        last = codes[-(len(FACTORS) - 1) :]
    if found and last[-1] != 32:
        yield np.concatenate([last, np.full(1, 32, np.uint32)])


def grams(text: str, settings: Settings) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, piece by piece."""
    shift, overlap = np.uint32(32 - settings.bits), 0
    for codes in pieces(text, settings.chunk):
        found = []
        for n, factors in enumerate(FACTORS, 1):
            fresh = codes[max(0, overlap - n + 1) :]
            if len(fresh) < n:
                continue
            mixed = np.zeros(len(fresh) - n + 1, np.uint32)
            for k, factor in enumerate(factors):
                mixed += fresh[k : k + len(mixed)] * np.uint32(factor)
            mixed ^= mixed >> np.uint32(15)
            found.append((mixed * np.uint32(0x2C1B3C6D)) >> shift)
        yield np.concatenate(found)
        overlap = min(len(codes), len(FACTORS) - 1)


def train(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the columns text and lang of all rows; rows with a null in either count for nothing.

    Counting is spread over the partitions, each of which sends one row per language and
    bucket; without any row the model knows no language.
    """
    rows = rows.select("text", "lang").where("text is not null and lang is not null")

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                counts = seen.setdefault(lang, np.zeros((1 << settings.bits) + 1, np.int64))
                counts[-1] += 1
                for buckets in grams(text, settings):
                    counts[:-1] += np.bincount(buckets, minlength=1 << settings.bits)
        for lang, counts in seen.items():
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(there)), pa.array(there), pa.array(counts[there])],
                ["lang", "bucket", "n"],
            )

    counts = saved(
        rows.mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    languages = [
        r.lang for r in counts.select("lang").distinct().limit(settings.max_languages + 1).collect()
    ]
    if len(languages) > settings.max_languages:
        raise ValueError(f"over {settings.max_languages} languages")
    languages = tuple(sorted(languages))
    table = counts.toArrow()
    matrix = np.zeros((len(languages), (1 << settings.bits) + 1))
    column = {lang: i for i, lang in enumerate(languages)}
    at = [column[lang] for lang in table["lang"].to_pylist()]
    matrix[at, table["bucket"].to_numpy()] = table["n"].to_numpy()
    smooth = matrix[:, :-1] + settings.smoothing
    return Model(
        languages,
        np.log(matrix[:, -1] / max(1.0, matrix[:, -1].sum())) if languages else np.zeros(0),
        np.ascontiguousarray(
            np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
        ),
        settings,
    )


def score_batch(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Languages and posteriors of a batch, as one sparse product cut into bounded pieces."""
    totals = np.zeros((len(texts), len(model.languages)))
    known = np.zeros(len(texts), bool)
    limit = max(1 << 14, (1 << 22) // max(1, len(model.languages)))
    held: list[np.ndarray] = []
    owners: list[int] = []

    def flush():
        starts = np.cumsum([0, *map(len, held[:-1])])
        sums = np.add.reduceat(
            model.log_prob[np.concatenate(held)], starts, axis=0, dtype=np.float64
        )
        np.add.at(totals, owners, sums)
        held.clear()
        owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for buckets in grams(text or "", model.settings):
            known[i] = True
            for at in range(0, len(buckets), limit):
                held.append(buckets[at : at + limit])
                owners.append(i)
                waiting += len(held[-1])
                if waiting >= limit:
                    flush()
                    waiting = 0
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    if held:
        flush()
    totals += model.log_prior
    best = totals.argmax(axis=1)
    posterior = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
    return (
        [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
        [float(p) if k else 0.0 for p, k in zip(posterior, known, strict=True)],
    )


def predict(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of the rows, and lang_pred and score; columns of these names are replaced.

    A text that is null or has no letter, or a model without languages, gives ``und`` and 0.
    Ties go to the language whose name comes first. Prediction reads the text alone.
    """
    rows = rows.drop("lang_pred", "score")
    schema = T.StructType([*rows.schema.fields])
    schema = schema.add("lang_pred", "string").add("score", "double")
    shared, at = rows.sparkSession.sparkContext.broadcast(model), rows.columns.index(text)

    def label(batches):
        for batch in batches:
            langs, scores = score_batch(batch.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                schema.names,
            )

    return rows.mapInArrow(label, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether a document is kept out of learning: one fold by the checksum of its id.

    A null id is kept out as well.
    """
    checksum = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(checksum % folds == 0, F.lit(True))
