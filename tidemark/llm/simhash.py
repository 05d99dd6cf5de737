"""Near duplicates by SimHash: fingerprints, and a binary trie self-join under a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import graph, shared, words

#: Most fingerprints of a task's group; a larger group is cut into chunks that are joined pair by pair.
GROUP = 16_384
#: Fingerprints that a group should hold on average; decides how many bits the tries' roots share.
EXPECTED = 64
#: Node pairs that are carried at once, and the pairs of leaves below a node pair that are compared without further descent.
FRONTIER, FEW = 1 << 20, 16

_BYTES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    padded = padded.reshape(-1, 255)
    out = 0
    for k in range(8):  # bit k of every byte: up to 255 of them add up inside a byte
        sums = ((padded >> np.uint64(k)) & _BYTES).sum(axis=1, dtype=np.uint64)
        counts = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(byte) + k)
    return out


def fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    """The fingerprint of a text's shingles, repeats included; a shorter text is one shingle, a text without words is 0."""
    found = words.lower_words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])], np.uint64))


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``ident`` and ``fp``, the fingerprint's 64 bits as a signed long. A null text has the fingerprint 0."""
    kind = dict(docs.dtypes)[ident]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [ident, "fp"])

    return words.map_batches(docs.select(ident, F.col(text).cast("binary").alias("_text")), run, f"`{ident}` {kind}, fp bigint")


def _masks(budget: int, n: int) -> list[int]:
    """The bit masks of which two values within the budget agree on one at least.

    64 bits are cut into m blocks of which ``budget`` at most hold a difference, so that m - ``budget`` blocks agree; m is the least
    for which these have enough bits to keep the groups of n values small.
    """
    for m in range(budget + 1, 2 * budget + 5):
        width = 64 // m
        if width * (m - budget) >= np.log2(max(n, 1) / EXPECTED + 1) or m == 2 * budget + 4:
            blocks = [((1 << width) - 1) << (i * width) for i in range(m)]
            return [sum(c) for c in combinations(blocks, m - budget)]
    raise AssertionError


def trie_links(values: np.ndarray, first: np.ndarray, middle: np.ndarray, last: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect exactly the values which differ in ``budget`` bits or fewer, joined transitively.

    Root r pairs the values at [first, middle) with those at [middle, last), or [first, last) with itself where
    middle = last; each range is sorted, and so is a binary trie of which a node is a range. Node pairs descend together bit by
    bit. They carry the bits in which they differ so far, and are dropped beyond the budget. If all that is left below two nodes can
    differ only in the bits that the budget still has, all their values are linked at once.
    """
    n = len(values)
    found_i, found_j = [], []
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alone = middle == last
    stack = [(64, first, np.where(alone, last, middle), np.where(alone, first, middle), last, np.zeros(len(first), np.int64))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONTIER:
            cut = len(a0) // 2
            stack += [(depth, *(x[cut:] for x in (a0, a1, b0, b1, diff))), (depth, *(x[:cut] for x in (a0, a1, b0, b1, diff)))]
            continue
        same = (a0 == b0) & (a1 == b1)
        few = ((a1 - a0) * (b1 - b0) <= FEW) | (depth == 0)
        if few.any():
            x0, nx, y0, ny = a0[few], (a1 - a0)[few], b0[few], (b1 - b0)[few]
            total = nx * ny
            at = np.repeat(np.arange(len(total)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            i, j = x0[at] + k // ny[at], y0[at] + k % ny[at]
            close = np.bitwise_count(values[i] ^ values[j]) <= budget
            close &= i != j
            found_i.append(i[close])
            found_j.append(j[close])
            a0, a1, b0, b1, diff, same = (x[~few] for x in (a0, a1, b0, b1, diff, same))
        if not len(a0):
            continue
        # In a sorted range, no bit above the highest in which the first and the last value differ varies.
        spread = ((values[a0] ^ values[a1 - 1]) | (values[b0] ^ values[b1 - 1]) | (values[a0] ^ values[b0])) & np.uint64((1 << depth) - 1)
        low = np.where(spread == 0, 0, np.floor(np.log2(np.maximum(spread, 1).astype(np.float64))).astype(np.int64) + 1)
        whole = diff + low <= budget  # below the nodes only the lowest ``low`` bits vary, so every two values are within the budget
        if whole.any():
            for s0, s1, t0, t1 in zip(a0[whole], a1[whole], b0[whole], b1[whole]):
                members = np.concatenate([np.arange(s0, s1), np.arange(t0, t1)])
                found_i.append(members[1:])
                found_j.append(np.full(len(members) - 1, members[0]))
            a0, a1, b0, b1, diff, same = (x[~whole] for x in (a0, a1, b0, b1, diff, same))
        if not len(a0):
            continue
        bit = depth - 1
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        c = ones[bit]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
        parts.append(tuple(x[~same] for x in (am, a1, b0, bm, diff + 1)))
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts))
        keep = (a1 > a0) & (b1 > b0) & (diff <= budget)
        stack.append((bit, *(x[keep] for x in (a0, a1, b0, b1, diff))))
    return np.concatenate([np.zeros(0, np.int64), *found_i]), np.concatenate([np.zeros(0, np.int64), *found_j])


def hamming_links(distinct: DataFrame, budget: int, n: int) -> DataFrame:
    """``a`` and ``b``: links between the ``rep`` of distinct fingerprints ``fp`` that connect all within the budget.

    Every value goes to the group of its bits under each mask. Groups are tries of their own, held by one task up to
    ``GROUP`` values; a larger one is cut into chunks by a hash and each pair of chunks is a task. A task returns the links of a spanning
    forest, fewer than its values, whatever the number of close pairs.
    """
    shared.ready_workers(distinct.sparkSession)
    masks = _masks(budget, n)
    dealt = distinct.select("fp", "rep", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")) for m in masks))).alias("mask", "part"))
    hot = dealt.groupBy("mask", "part").count().where(F.col("count") > GROUP).select("mask", "part", F.ceil(F.col("count") / GROUP).cast("int").alias("chunks"))
    placed = dealt.join(hot, ["mask", "part"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["mask", "part", "low", "high"]
    placed = placed.select("mask", "part", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")).alias("order"), "rep")
    placed = placed.repartition(*keys).sortWithinPartitions(*keys, "chunk", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def joined(columns: list[np.ndarray]) -> pa.RecordBatch:
            mask, part, low, high, chunk, order, rep = columns
            new = np.ones(len(rep), bool)
            new[1:] = (mask[1:] != mask[:-1]) | (part[1:] != part[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(rep))
            lows = np.add.reduceat((chunk == low).astype(np.int64), first)
            values = order.view(np.uint64) ^ np.uint64(1 << 63)
            i, j = trie_links(values, first, first + lows, last, budget)
            top = graph.roots(len(rep), i, j)
            child = np.flatnonzero(top != np.arange(len(rep)))
            return pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[top[child]])], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            tail = np.ones(len(columns[0]), bool)
            for c in columns[:4]:
                tail &= c == c[-1]
            cut = len(tail) - int(tail.sum())  # rows of the last group come together; it may go on in the next batch
            rest = [c[cut:] for c in columns]
            if cut:
                yield joined([c[:cut] for c in columns])
        if rest is not None and len(rest[0]):
            yield joined(rest)

    return placed.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 4, budget: int = 4, seed: int = 42) -> DataFrame:
    """``ident``, ``fp`` and ``component_id``, the smallest ``ident`` reachable by fingerprints within ``budget`` bits.

    Rows of equal fingerprints are one class; classes are joined by their smallest ``ident``. A text without words has the fingerprint
    0 and is linked like any other. A row of null ``ident`` gets its class's component, which is null if no row of the class has one. An
    empty table gives an empty table.
    """
    prints = shared.cut(fingerprints(docs, ident, text, shingle, seed))
    distinct = shared.cut(prints.groupBy("fp").agg(F.min(F.col(ident).cast("bigint")).alias("rep")))
    links = hamming_links(distinct.where("rep is not null"), budget, distinct.count())
    found = graph.components(links, "a", "b")
    classes = distinct.join(found, distinct.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select(ident, "fp", "component_id")
