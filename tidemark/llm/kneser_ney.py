"""An interpolated modified Kneser-Ney model: counted in Spark, kept as sorted hash arrays, mapped into the workers' memory.

A model of order n keeps, for each level k from 1 to n, the k-grams' hashes in order with their counts (adjusted counts below the top level: the
number of different words before), and for each context its total and how many k-grams of count 1, 2 and 3 or more it begins. The
arrays are cut into shards by the leading bits of the hash and lie in the shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blobs, shared, words

#: Hashes of the end of a text and of the place before its first word; words hash to these with a chance of 2 in 2**64.
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
#: Tokens whose n-grams a worker gathers before it hands them on.
GATHERED = 3_000_000
#: Bytes of a file's header; then come the hashes, and beside them the numbers.
HEAD = 256


def text_tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' words, A-Z lower-cased, and of their ends; and where each text begins."""
    found, size = words.text_words(texts)
    ends = np.cumsum(size + 1) - 1
    out = np.empty(len(found) + len(texts), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = found, END
    return out, ends - size


def grams(token: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-gram that ends at each token, a column for each of its words; before a text's first word stands START."""
    place = np.arange(len(token)) - np.repeat(first, np.diff(np.append(first, len(token))))
    columns = []
    for back in range(order - 1, 0, -1):
        before = np.concatenate([np.full(min(back, len(token)), START), token[: max(len(token) - back, 0)]])
        columns.append(np.where(place < back, START, before))
    return [*columns, token]


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of some words in a row from their hashes."""
    out = columns[0]
    for c in columns[1:]:
        out = words.mixed_hash(out, c)
    return out


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of an n-gram by which it is dealt and found.

    Its leading 16 bits come from the context and four bits of the last word: most n-grams of a context lie together, and those of a very common one
    in sixteen places. The other 48 bits tell the n-grams there apart.
    """
    if len(columns) == 1:
        return columns[0]
    context, last = chained(columns[:-1]), columns[-1]
    high = np.uint64(0xFFFF << 48)
    return (words.mixed_hash(context, last >> np.uint64(60)) & high) | (words.mixed_hash(context, last) & ~high)


def _summed(key: np.ndarray, columns: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows of equal keys as one, in the keys' order: their first columns, and their sums added up."""
    if not len(key):
        return key, columns, sums
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], [c[order[first]] for c in columns], [np.add.reduceat(s[order], first) for s in sums]


@dataclass
class Model:
    """Where the arrays lie, and the totals that all texts share."""

    folder: str
    order: int
    shards: int
    tokens: int
    distinct: int
    discounts: list[list[float]]
    total: int
    taken: float


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The three discounts of a level from its counts of counts; 0.5, 1 and 1.5 where the counts are too few for them."""
    usual = [0.5, 1.0, 1.5]
    if not n1 or not n2:
        return usual
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else usual[2]]
    return [d if 0 < d < k + 1 else u for k, (d, u) in enumerate(zip(found, usual))]


def train(docs: DataFrame, learned: Column, order: int = 2, text: str = "text") -> Model:
    """Counts the rows for which ``learned`` holds; a null text counts as empty. Writes the arrays and returns where they are.

    Every partition adds up its own n-grams and deals them by hash to shards, each of which one task merges; the number of shards follows
    the number of input partitions. Level by level, a task then gives to the level below which word sequences are preceded
    by how many words, and to the contexts how many followers they have.
    """
    if order < 1:
        raise ValueError("the order is 1 or more")
    spark = docs.sparkSession
    shared.ready_workers(spark)
    rows = docs.where(learned).select(F.col(text).cast("binary").alias("_text"))
    shards = 1 << max(3, int(np.ceil(np.log2(max(1, 2 * rows.rdd.getNumPartitions())))))
    shards = min(shards, 1 << 16)
    folder = shared.new_folder(spark, "kneser-ney")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def counted() -> Iterator[tuple[str, int, bytes]]:
            columns = [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            key, _, sums = _summed(columns[-1], [], [np.ones(size, np.uint64)])
            yield from blobs.dealt("word", [key, *sums], key, shards)
            key, columns, sums = _summed(gram_key(columns), columns, [np.ones(size, np.uint64)])
            yield from blobs.dealt("gram", [*columns, *sums], key, shards, True)

        for batch in batches:
            token, first = text_tokens(batch.column(0).to_pylist())
            parts.append(grams(token, first, order))
            size += len(token)
            if size >= GATHERED:
                yield from blobs.in_rows(counted())
                size = 0
        if size:
            yield from blobs.in_rows(counted())

    def merge(level: int):
        """One level's rows, a shard at a time, to arrays in the folder and to the rows of the level below."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = [], None
            for batch in batches:
                for kind, shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if (kind, shard) != at and held:
                        yield from blobs.in_rows(merged(*at, held))
                        held = []
                    at = (kind, shard)
                    held.append(data if kind == "tally" else blobs.unpacked(data))
            if held:
                yield from blobs.in_rows(merged(*at, held))

        def merged(kind: str, shard: int, parts: list) -> Iterator[tuple[str, int, bytes]]:
            if kind == "tally":
                yield from ((kind, shard, data) for data in parts)
                return
            columns = [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            if kind == "word":
                key, _, (n,) = _summed(columns[0], [], columns[1:])
                write("word", 0, shard, [key, n])
                yield "tally", shard, blobs.packed([np.array([0, n.sum(), len(n)], np.uint64)])
            elif kind == "context":
                key, _, sums = _summed(columns[0], [], columns[1:])
                write("context", level + 1, shard, [key, *sums])
            else:
                key, columns, (n,) = _summed(gram_key(columns[:level]), columns[:level], columns[level:])
                write("gram", level, shard, [key, n])
                counts = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5]
                yield "tally", shard, blobs.packed([np.array([level, *counts, n.sum()], np.uint64)])
                if level > 1:
                    # The followers of the contexts; and the rows of the level below, where each row here is one more word before.
                    key, _, sums = _summed(chained(columns[:-1]), [], [n, *((n == k).astype(np.uint64) for k in (1, 2)), (n > 2).astype(np.uint64)])
                    yield from blobs.dealt("context", [key, *sums], key, shards)
                    key, rest, sums = _summed(gram_key(columns[1:]), columns[1:], [np.ones(len(n), np.uint64)])
                    yield from blobs.dealt("gram", [*rest, *sums], key, shards, level > 2)

        def write(kind: str, depth: int, shard: int, columns: list[np.ndarray]) -> None:
            kinds = ["<u8", *(blobs.fewest(int(c.max()) if len(c) else 0) for c in columns[1:])]
            head = json.dumps({"rows": len(columns[0]), "kinds": kinds}).encode().ljust(HEAD)
            shared.put(f"{folder}/{kind}-{depth}-{shard}", b"".join([head, *(c.astype(k).tobytes() for c, k in zip(columns, kinds))]))

        return run

    # One job: each level is merged from the shuffle above, and a few numbers of each shard come to the driver.
    stage = rows.mapInArrow(gather, blobs.SCHEMA)
    for level in range(order, 0, -1):
        stage = stage.repartition(shards, "kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(merge(level), blobs.SCHEMA)
    tallies, tokens, distinct = np.zeros((order + 1, 5), np.int64), 0, 0
    for r in stage.collect():
        level, *found = blobs.unpacked(bytes(r["data"]))[0].astype(np.int64)
        if level:
            tallies[level] += found
        else:
            tokens, distinct = tokens + int(found[0]), distinct + int(found[1])
    discounts = [_discounts(*map(int, tallies[k][:4])) for k in range(1, order + 1)]
    one, two = (int(x) for x in tallies[1][:2])
    taken = one * discounts[0][0] + two * discounts[0][1] + (distinct - one - two) * discounts[0][2]  # every word is a row of level 1
    return Model(folder, order, shards, tokens, distinct, discounts, int(tallies[1][4]), float(taken))


class Arrays:
    """Shards of one kind and level, mapped when they are first asked for."""

    def __init__(self, model: Model, kind: str, level: int):
        self._model, self._name, self._open = model, f"{kind}-{level}", {}

    def _shard(self, shard: int) -> list[np.ndarray]:
        if shard not in self._open:
            try:
                raw = shared.mapped(f"{self._model.folder}/{self._name}-{shard}")
            except FileNotFoundError:  # no hash begins with these bits
                raw = None
            columns = []
            if raw is not None:
                head = json.loads(raw[:HEAD].tobytes())
                at = HEAD
                for kind in head["kinds"]:
                    size = head["rows"] * np.dtype(kind).itemsize
                    columns.append(raw[at : at + size].view(kind))
                    at += size
            self._open[shard] = columns
        return self._open[shard]

    def get(self, keys: np.ndarray, n: int) -> list[np.ndarray]:
        """``n`` columns for the keys, which are in order; 0 for those that are not there."""
        out = [np.zeros(len(keys)) for _ in range(n)]
        shards = self._model.shards
        edges = np.searchsorted(keys, (np.arange(1, shards, dtype=np.uint64) << np.uint64(64 - (shards - 1).bit_length())), "left")
        for s, (a, b) in enumerate(zip([0, *edges], [*edges, len(keys)])):
            if b > a and (columns := self._shard(s)) and len(columns[0]):
                at = np.minimum(np.searchsorted(columns[0], keys[a:b]), len(columns[0]) - 1)
                hit = columns[0][at] == keys[a:b]
                for o, c in zip(out, columns[1:]):
                    o[a:b] = np.where(hit, c[at], 0)
        return out


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._words = Arrays(model, "word", 0)
        self._grams = [Arrays(model, "gram", k) for k in range(1, model.order + 1)]
        self._contexts = [Arrays(model, "context", k) for k in range(2, model.order + 1)]

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text."""
        m, k = self.model, self.model.order
        token, first = text_tokens(texts)
        size = np.diff(np.append(first, len(token)))
        columns = grams(token, first, k)
        single, back = np.unique(token, return_inverse=True)
        count = self._words.get(single, 1)[0]
        base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.distinct + 1)))[back]
        known = (count > 0)[back]
        # Level 1: adjusted counts, and the mass taken from them spread over the words known and one unknown.
        if m.total:
            chance = ((self._discounted(1, self._grams[0].get(single, 1)[0]) + m.taken / (m.distinct + 1)) / m.total)[back]
        else:
            chance = np.ones(len(token))
        for level in range(2, k + 1):
            own = columns[k - level :]
            contexts, of = np.unique(chained(own[:-1]), return_inverse=True)
            total, one, two, more = self._contexts[level - 2].get(contexts, 4)
            d = m.discounts[level - 1]
            left = np.where(total > 0, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(total, 1), 1.0)
            keys, to = np.unique(gram_key(own), return_inverse=True)
            seen = self._discounted(level, self._grams[level - 1].get(keys, 1)[0])[to]
            chance = seen / np.maximum(total, 1)[of] + left[of] * chance
        return size, np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(chance), first)

    def _discounted(self, level: int, count: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.model.discounts[level - 1]])
        return np.maximum(count - d[np.minimum(count, 3).astype(np.int64)], 0)


_scorers: dict[str, Scorer] = {}


def scored(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity`` of every whole text.

    A null text is scored like an empty one: its end only. A model of nothing gives every token the chance 1. Workers map the arrays'
    shards as they need them, and search sorted keys in them.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own: Model = held.value
        if own.folder not in _scorers:
            _scorers.clear()
            _scorers[own.folder] = Scorer(own)
        n, known, base, score = _scorers[own.folder].batch(batch.column(1).to_pylist())
        arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), own.tokens), pa.int64()), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / n))]
        return pa.RecordBatch.from_arrays(arrays, [ident, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = dict(docs.dtypes)[ident]
    return words.map_batches(docs.select(ident, F.col(text).cast("binary").alias("_text")), run, f"`{ident}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
