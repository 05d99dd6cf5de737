"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words

#: Rows of each language that are learned from, on average, and of all languages together: the bound of the sample.
SAMPLE, SAMPLE_ALL = 600, 6000
#: Buckets of hashed n-grams; n-grams of two and three bytes.
BUCKETS = 1 << 13
#: A language is ambiguous below this score.
SURE = 0.6
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: Bytes of n-grams: ASCII letters lower-cased, other ASCII as one space, the rest as they are.
_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def profile(text: str) -> np.ndarray:
    """How often each bucket's n-grams are in the whole text."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_BYTES), np.uint8).astype(np.uint32)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)  # runs of spaces are one
    raw = raw[keep]
    two = raw[:-1] * np.uint32(0x9E3779B1) + raw[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(31) + raw[2:] * np.uint32(0xC2B2AE3D) + np.uint32(1)
    at = np.concatenate([two, three])
    return np.bincount((at ^ (at >> np.uint32(15))) >> np.uint32(4) & np.uint32(BUCKETS - 1), minlength=BUCKETS)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of n languages.

    Up to five languages get the exhaustive code (each split of them once); more get the random code of 15 bits a doubling, of
    several drawn, whose nearest two words are farthest apart.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        return np.array([(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest], float).T
    random, best, apart = np.random.default_rng(seed), None, -1.0
    for _ in range(50):
        code = np.where(random.random((n, int(15 * np.ceil(np.log2(n))))) < 0.5, 1.0, -1.0)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        distance = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(distance, np.inf)
        if distance.min() > apart:
            best, apart = code, distance.min()
    return best


@dataclass
class Model:
    """Bit classifiers: a bit's value is ``scale`` times the mean weight of a text's n-grams, plus ``bias``."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def values(self, profiles: np.ndarray) -> np.ndarray:
        n = profiles.sum(axis=1, keepdims=True)
        return (profiles @ self.weights) / (n + 20) * self.scale + self.bias * n / (n + 20)

    def decode(self, values: np.ndarray) -> np.ndarray:
        """The chance of each language: soft minimum of the trusted logistic losses against its codeword."""
        loss = np.logaddexp(0, -values[:, None, :] * self.code[None]) @ self.trust
        loss -= loss.min(axis=1, keepdims=True)
        chance = np.exp(-loss)
        return chance / chance.sum(axis=1, keepdims=True)


def fit(profiles: np.ndarray, target: np.ndarray, languages: list[str]) -> Model:
    """Learns from profiles (rows of counts) and their languages' indexes."""
    code = codewords(len(languages))
    share = profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1)
    means = np.stack([share[target == k].mean(axis=0) if (target == k).any() else np.zeros(BUCKETS) for k in range(len(languages))])
    means = (means + 0.1 / BUCKETS) / 1.1
    weights = np.stack([np.log(means[bit > 0].mean(axis=0)) - (np.log(means[bit < 0].mean(axis=0)) if (bit < 0).any() else 0) for bit in code.T], axis=1)
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    raw = model.values(profiles)
    for b in range(code.shape[1] if len(languages) > 1 else 0):
        y, a, c = code[target, b], 1.0, 0.0
        spread = raw[:, b].std() or 1.0
        x = raw[:, b] / spread
        for _ in range(200):  # logistic loss with a small penalty, so that separable bits have an end
            p = 1 / (1 + np.exp(np.clip(y * (a * x + c), -50, 50)))
            a, c = a + 2.0 * ((p * y * x).mean() - 1e-3 * a), c + 2.0 * ((p * y).mean() - 1e-3 * c)
        model.scale[b], model.bias[b] = a / spread, c
        wrong = (np.sign(a * x + c) != y).mean()
        model.trust[b] = 0.5 * np.log((1 - wrong + 1e-2) / (wrong + 1e-2))
    model.trust = np.maximum(model.trust, 0) / max(model.trust.max(), 1e-9) if len(languages) > 1 else model.trust
    return model


def learn(docs: DataFrame, learned: Column, ident: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the rows for which ``learned`` holds and text and language are not null.

    The rows are a sample by a hash of ``ident``, about ``sample`` of each language and SAMPLE_ALL in all; their profiles, of fixed size, go to the driver.
    Rows of null ``ident`` are taken or left together.
    """
    rows = docs.where(learned & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row for each language
    languages = sorted(counts)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1)), np.ones(1), np.zeros(1), np.ones(1))
    sample = max(1, min(sample, SAMPLE_ALL // len(languages)))
    portion = F.lit(0.0)
    for name, n in counts.items():
        portion = F.when(F.col(lang) == name, min(1.0, sample / n)).otherwise(portion)
    place = F.pmod(F.xxhash64(F.col(ident).cast("string"), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [profile(words.decoded(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype("<u2" if p.max() < 1 << 16 else "<u4").tobytes() for p in found], pa.binary())], ["lang", "counts"])

    chosen = rows.where(place < portion).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text")).limit(2 * sample * len(languages))
    got = words.map_batches(chosen, run, "lang string, counts binary").collect()
    index = {name: k for k, name in enumerate(languages)}
    profiles = np.zeros((len(got), BUCKETS), np.float32)
    for k, r in enumerate(got):
        profiles[k] = np.frombuffer(r["counts"], "<u2" if len(r["counts"]) == 2 * BUCKETS else "<u4")
    return fit(profiles, np.array([index[r["lang"]] for r in got], int), languages)


def predict(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, ``lang_pred``, ``score`` (0 to 1), ``ambiguous`` and ``runner_up`` of every whole text.

    The language is ``und`` with score 0 for null, for a text without a letter, and where nothing was learned.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own: Model = held.value
        texts = [words.decoded(t) for t in batch.column(1).to_pylist()]
        known = [k for k, t in enumerate(texts) if t and own.languages and _LETTER.search(t)]
        name, score, next_best = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
        for some in (known[k : k + 64] for k in range(0, len(known), 64)):
            chance = own.decode(own.values(np.stack([profile(texts[k]) for k in some]).astype(np.float32)))
            order = np.argsort(-chance, axis=1, kind="stable")
            for k, c, o in zip(some, chance, order):
                name[k], score[k] = own.languages[o[0]], min(1.0, float(c[o[0]]))
                next_best[k] = own.languages[o[1]] if len(o) > 1 else None
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(name), pa.array(score), pa.array(score < SURE), pa.array(next_best, pa.string())], [ident, "lang_pred", "score", "ambiguous", "runner_up"])

    return words.map_batches(docs.select(ident, F.col(text).cast("binary").alias("_text")), run, f"`{ident}` {dict(docs.dtypes)[ident]}, lang_pred string, score double, ambiguous boolean, runner_up string")
