"""Words of whole texts, as bytes and as 64-bit hashes, for operators that run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import lean, shared  # noqa: F401  (lean settles the workers' memory)

def decoded(text: bytes | None) -> str:
    """A text as a string: empty for null; bytes that are no UTF-8 are replaced."""
    return text.decode("utf-8", "replace") if text else ""


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; none for null."""
    return text.lower().split() if text else []


#: ASCII white space, and the multiplier of the polynomial hash (odd, so that it has an inverse modulo 2**64).
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at a time, and the powers of the multiplier and its inverse for so many.
_WINDOW = 1 << 16
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _WINDOW)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word between ASCII white space, and where it starts. No object is made for a word.

    A word's hash is the polynomial of its bytes, as the difference of two running sums, mixed with its length. Text is taken in
    windows that end at white space; a word longer than a window is a window by itself.
    """
    data, at, found, places = np.frombuffer(raw, np.uint8), 0, [], []
    while at < len(data):
        end = min(at + _WINDOW, len(data))
        if end < len(data):
            space = np.flatnonzero(_SPACE[data[at:end]])
            if len(space):
                end = at + int(space[-1]) + 1
            else:
                more = re.compile(rb"[\x20\x09-\x0D]").search(raw, end)
                end = more.end() if more else len(data)
        part = data[at:end]
        power, inverse = _powers(len(part))
        word = np.zeros(len(part) + 2, np.int8)
        word[1:-1] = ~_SPACE[part]
        edge = np.diff(word)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        found.append(mixed_hash((sums[stop] - sums[start]) * inverse[start], (stop - start).astype(np.uint64)))
        places.append(start + at)
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate([np.zeros(0, np.int64), *places])


def text_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, A-Z lower-cased, and how many each text has; null has none."""
    texts = [t or b"" for t in texts]
    token, start = hashed_words(b"\n".join(texts).lower())
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return token, np.diff(np.searchsorted(start, edges))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """``function`` over the Arrow batches of ``df``; ``after`` is called when a task ends, however it does."""
    shared.ready_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows and (out := function(batch)) is not None:
                    yield out
        finally:
            if after is not None:
                after()

    return df.mapInArrow(run, schema)


def mixed_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
