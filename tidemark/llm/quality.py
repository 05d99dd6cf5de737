"""Quality by compression: which of two zstandard dictionaries, of good and of bad text, makes a text smaller."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import ranks, shared, words

#: Labelled rows of each class that are learned from, at most: the bound of the sample.
SAMPLE = 3000
#: Bytes that are compressed at a time. A text is cut into such pieces, so that the dictionary and not the text before it helps.
PIECE = 256
#: The size of a dictionary, and the compression level.
DICTIONARY, LEVEL = 32_768, 3
#: Bytes added to a text's size, so that the difference of a few bytes says little of a short text.
SMOOTH = 60


@dataclass
class Model:
    """Two dictionaries, and the points between which a difference's score is interpolated."""

    good: bytes
    bad: bytes
    at: np.ndarray
    value: np.ndarray

    def score(self, difference: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(difference, self.at, self.value), 0.0, 1.0)


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        def made(raw: bytes):
            held = zstandard.ZstdCompressionDict(raw) if raw else None
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self._good, self._bad = made(good), made(bad)

    def difference(self, text: bytes) -> float:
        """Size by the bad dictionary less size by the good one, over the text's size; 0 for an empty text."""
        total = 0
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            total += len(self._bad(piece)) - len(self._good(piece))
        return total / (len(text) + SMOOTH)


def _differences(rows: DataFrame, good: bytes, bad: bytes, text: str, model: Model | None = None, whole: bool = False, called: tuple[str, str] = ("difference", "score")) -> DataFrame:
    """The rows with ``difference``, and ``score`` where there is a model, in place of the text; or beside it, if they are to be ``whole``."""
    held = rows.sparkSession.sparkContext.broadcast((good, bad, model))
    keep, kinds = [c for c in rows.columns if c != text], dict(rows.dtypes)
    names = [*([text] if whole else []), *keep]
    out = list(called if model else called[:1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        *files, curve = held.value
        own = Compressors(*files)
        found = np.array([own.difference(t or b"") for t in batch.column(0).to_pylist()])
        given = [batch.column(0).view(pa.string())] if whole else []
        return pa.RecordBatch.from_arrays([*given, *batch.columns[1:], pa.array(found), *([pa.array(curve.score(found))] if curve else [])], [*names, *out])

    return words.map_batches(rows.select(F.col(text).cast("binary").alias(shared.fresh(keep, "_text")), *keep), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), *(f"`{c}` double" for c in out)]))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary of the distinct pieces, in the order of a hash; of few pieces, their text itself."""
    pieces = sorted(set(pieces), key=lambda p: (xxhash.xxh64_intdigest(p), p))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:DICTIONARY]


def _calibrated(difference: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising curve of the chance of label 1: pooled means of eight rows or more (fewer of a small sample), with a slight slope."""
    least = max(1, min(8, len(label) // 50))
    order = np.argsort(difference, kind="stable")
    x, y, w = difference[order], label[order].astype(float), weight[order]
    cuts = np.arange(0, len(x), least)
    total, ones, mass = (np.add.reduceat(v, cuts) for v in (w, w * y, w * x))
    blocks: list[list[float]] = []
    for t, o, m in zip(total, ones, mass):
        blocks.append([t, o, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:  # falls or stays: pool
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    at = np.array([-1.0, *(m / t for t, _, m in blocks), 1.0])
    chance = np.array([(o + 0.02) / (t + 0.04) for t, o, _ in blocks])
    value = np.array([chance[0] / 2, *chance, (1 + chance[-1]) / 2])
    return at, np.maximum.accumulate(value)


def learn(docs: DataFrame, labels: DataFrame, learned: Column, ident: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows for which ``learned`` holds.

    The ``sample`` rows of each class that come first by a hash of ``ident`` are learned from, with their whole texts: two thirds build the dictionaries, one third
    calibrates. Of rows of equal ``ident``, the one of the least text is learned from. A row with two different labels counts as the lower. Null labels and labels other than 0 and 1 are not learned from.
    Where a class has no row, every text gets the smoothed share of the other.
    """
    spark = docs.sparkSession
    known = labels.where(learned & F.col(label).isin(0, 1)).groupBy(ident).agg(F.min(label).cast("int").alias("_label"))
    sizes = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    flat = np.array([-1.0, 1.0]), np.full(2, (good + 1) / (good + bad + 2))
    if not good or not bad:
        return Model(b"", b"", *flat)
    keyed = known.withColumn("_key", ranks.seeded_key("quality", ident))
    chosen = keyed.where("_label = 1").orderBy("_key").limit(sample).union(keyed.where("_label = 0").orderBy("_key").limit(sample))
    # 2 * sample rows at most, so they can be broadcast; the texts are met in the scan, without a shuffle.
    found = docs.where(F.col(text).isNotNull()).select(ident, F.col(text).cast("binary").alias("_text"))
    rows = found.join(F.broadcast(chosen), ident).groupBy(ident, "_label", "_key").agg(F.min("_text").alias("_text"))  # of rows of equal ident, one is learned from
    rows = shared.cut(rows.withColumn("_fits", F.pmod(F.xxhash64(F.col("_key")), F.lit(3)) == 0))

    def cut_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, pieces = [], []
        for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for at in range(0, len(t), PIECE):
                kinds.append(k)
                pieces.append(t[at : at + PIECE])
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(pieces, pa.binary())], ["kind", "piece"])

    pieces: dict[int, list[bytes]] = {0: [], 1: []}
    for r in words.map_batches(rows.where("not _fits").select("_text", "_label"), cut_up, "kind int, piece binary").coalesce(4).toLocalIterator():
        pieces[r["kind"]].append(bytes(r["piece"]))
    if not pieces[0] or not pieces[1]:
        return Model(b"", b"", *flat)
    good_file, bad_file = _dictionary(pieces[1]), _dictionary(pieces[0])
    got = _differences(rows.where("_fits").select("_text", "_label"), good_file, bad_file, "_text").collect()
    y = np.array([r["_label"] for r in got], int)
    if not len(y) or y.min() == y.max():
        return Model(good_file, bad_file, np.array([-1.0, 1.0]), np.array([0.0, 1.0]))
    share = np.where(y == 1, good / (good + bad) / max((y == 1).sum(), 1), bad / (good + bad) / max((y == 0).sum(), 1)) * len(y)
    return Model(good_file, bad_file, *_calibrated(np.array([r["difference"] for r in got]), y, share))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", whole: bool = False, called: tuple[str, str, str] = ("difference", "score", "predicted")) -> DataFrame:
    """The rows, without their text unless they are to be ``whole``, with ``difference``, ``score`` (the chance of label 1) and ``predicted`` (1 if score >= threshold).

    A null text is scored like an empty one, whose difference is 0. The results have the names ``called``; columns of these names are replaced.
    """
    difference, score, predicted = called
    found = _differences(docs.select(*(c for c in docs.columns if c not in called)), model.good, model.bad, text, model, whole, (difference, score))
    return found.withColumn(predicted, F.when(F.col(score) >= threshold, 1).otherwise(0))
