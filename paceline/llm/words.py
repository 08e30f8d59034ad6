"""Shingles of words as hashes, a text at a time with numpy."""

import numpy as np

_tables: dict[str, np.ndarray] = {}
#: An odd base of rolling hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse."""
    if "base" not in _tables or len(_tables["base"]) < n:
        size = max(n, 1 << 14)
        for name, step in (("base", BASE), ("inverse", INVERSE)):
            steps = np.full(size, step, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["base"], _tables["inverse"]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every range; equal contents have equal hashes."""
    base, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * base[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash for each word, a run of letters and digits in lower case."""
    if "words" not in _tables:
        _tables["words"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool)
    found, at, size = [], 0, len(text or "")
    while at < size:
        end = at + PIECE
        while end < size and text[end - 1].isalnum():
            end += 1
        codes = np.frombuffer(
            text[at:end].lower().encode("utf-32-le", "surrogatepass"), "<u4"
        )
        edges = np.diff(_tables["words"][codes].astype(np.int8), prepend=0, append=0)
        found.append(range_hashes(codes, np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of all words if there are fewer."""
    words = word_hashes(text)
    if not len(words):
        return words
    runs = max(1, len(words) - size + 1)
    total = np.zeros(runs, np.uint64)
    for k in range(min(size, len(words))):
        total = (total + words[k : k + runs]) * np.uint64(BASE)
    return np.unique(mixed(total))
