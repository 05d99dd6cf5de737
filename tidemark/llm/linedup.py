"""Line deduplication by an exact set-similarity join with prefix, length, positional and signature filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import blobs, shared, words

#: Buckets of the table of token counts (a power of two), in slices of SLICE. A token's bucket only decides its place in the order.
BUCKETS, SLICE = 1 << 22, 1 << 16
#: A posting list that may be longer than this is cut into chunks that are joined pair by pair.
LONG = 50_000
#: Pairs that are compared at once, and postings that a worker gathers before it deals them.
PAIRS, GATHERED = 400_000, 250_000
#: Candidates that a worker hands on in one batch.
HANDED = 50_000
#: Candidates that a line gets from each list, and in all, in the first round. Lines of which none matches though there were more get MORE times
#: as many in the next, and so on until there are no more, so the result does not depend on it, and every round's candidates are bounded.
FIRST, MORE = 8, 64
#: Lines (or texts) of so many at most are told from others by a bitmap of MARKS bits that is sent to the scan of the texts; more are joined to the texts.
MARKED, MARKS = 1 << 21, 1 << 25
#: The numbers of so many documents at most (eight bytes each) are broadcast besides, so that other texts are not handed to Python.
FEW = 50_000

_U = np.uint64


class Rule:
    """The arithmetic of a Jaccard threshold, in whole numbers."""

    def __init__(self, threshold: float):
        self.t = Fraction(threshold).limit_denominator(10_000)
        if not 0 < self.t <= 1:
            raise ValueError("the threshold is above 0 and at most 1")

    def least_overlap(self, total: np.ndarray) -> np.ndarray:
        """Tokens that two sets of ``total`` tokens together must share."""
        p, q = self.t.numerator, self.t.denominator + self.t.numerator
        return -(-(total * p) // q)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Of a set's tokens in order, how many hold one at least that any match shares."""
        return n - -(-(n * self.t.numerator) // self.t.denominator) + 1

    def longest(self, n: np.ndarray) -> np.ndarray:
        """The size of the largest match."""
        return n * self.t.denominator // self.t.numerator


def scanned(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts: the hash (A-Z lower-cased), a number that rises with each line, the text's place, and the line's number in it."""
    texts = [t or b"" for t in texts]
    raw = b"\n".join(texts).lower()
    token, start = words.hashed_words(raw)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), start)
    first = np.concatenate([[0], np.cumsum([t.count(b"\n") + 1 for t in texts])])[:-1].astype(np.int64)
    place = np.searchsorted(first, line, "right") - 1
    return token, line, place, line - first[place]


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of fourths of a doubling, from 0 to 255."""
    return np.minimum(np.ceil(4 * np.log2(np.maximum(counts, 1))), 255).astype(np.uint8)


def token_levels(docs: DataFrame, text: str, hashed: Callable[[list[bytes | None]], np.ndarray] = lambda texts: words.hashed_words(b"\n".join([t or b"" for t in texts]).lower())[0]) -> np.ndarray:
    """How common the tokens (words, or what ``hashed`` makes of texts) of each bucket are in all texts. The table has a fixed size, so it can be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            np.add.at(counts, (hashed(batch.column(0).to_pylist()) >> _U(64 - 22)).astype(np.int64), np.uint32(1))
        rows = []
        for s in range(BUCKETS // SLICE):
            at = np.flatnonzero(counts[s * SLICE : (s + 1) * SLICE])
            if len(at):
                rows.append(("count", s, blobs.packed([at.astype(np.uint64), counts[s * SLICE + at].astype(np.uint64)])))
        if rows:
            yield blobs.record_batch(rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at, n = blobs.unpacked(data)
                sums.setdefault(s, np.zeros(SLICE, np.uint64))[at.astype(np.int64)] += n
        if sums:
            yield blobs.record_batch([("level", s, _levels(c).tobytes()) for s, c in sums.items()])

    counted = docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(run, blobs.SCHEMA)
    out = np.zeros(BUCKETS, np.uint8)
    for r in counted.repartition(16, "shard").mapInArrow(add, blobs.SCHEMA).collect():  # a byte for each bucket
        out[r["shard"] * SLICE : (r["shard"] + 1) * SLICE] = np.frombuffer(bytes(r["data"]), np.uint8)
    return out


def _ordered(line: np.ndarray, token: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's distinct tokens, rare ones first: by level, then by hash."""
    level = levels[(token >> _U(64 - 22)).astype(np.int64)]
    order = np.argsort((line.astype(np.uint64) << _U(48)) | (level.astype(np.uint64) << _U(40)) | (token >> _U(24)))
    l, t = line[order], token[order]
    if line[-1] >= 1 << 16 or ((l[1:] == l[:-1]) & (t[1:] >> _U(24) == t[:-1] >> _U(24)) & (t[1:] != t[:-1])).any():
        order = np.lexsort((token, level, line))  # more lines than the key holds, or hashes that are alike in 40 bits
    line, token = line[order], token[order]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (token[1:] != token[:-1])])
    return line[new], token[new]


def _signature_bits(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit of a token in the two words of a set's signature, the parity of each bit."""
    mixed = words.mixed_hash(token, np.full(len(token), 77, np.uint64))
    bit = _U(1) << (mixed & _U(63))
    high = (mixed >> _U(6)) & _U(1) == 1
    return np.where(high, bit, _U(0)), np.where(high, _U(0), bit)


def _line_sets(docs: DataFrame, ident: str, text: str, rule: Rule, least: int, levels) -> DataFrame:
    """A row for each different token set of a document: hash, signature, size, prefix, and the first line that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                token, line, place, number = scanned(batch.column(1).to_pylist())
                if not len(token):
                    continue
                new = np.concatenate([[True], line[1:] != line[:-1]])
                doc, number = batch.column(0).to_numpy(zero_copy_only=False)[place[new]], number[new].astype(np.int32)
                size = np.diff(np.append(np.flatnonzero(new), len(token)))  # words, repeats included
                line, token = _ordered(np.cumsum(new) - 1, token, levels.value)
                first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                n = np.diff(np.append(first, len(line)))
                total = np.add.reduceat(words.mixed_hash(token, np.full(len(token), 77, np.uint64)), first)
                s1, s2 = (np.bitwise_xor.reduceat(x, first) for x in _signature_bits(token))
                # The first line of each set in its document; a later one is a copy inside the document.
                order = np.lexsort((number, total, doc))
                order = order[size[order] >= least]
                if not len(order):
                    continue
                new = np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (total[order][1:] != total[order][:-1])])
                keep = np.sort(order[new])
                p = rule.prefix(n[keep])
                at = np.repeat(first[keep], p) + np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
                prefix = (token[at] >> _U(32)).astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(4 * p)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(prefix.tobytes())])
                arrays = [*(pa.array(x[keep].view(np.int64)) for x in (total, s1, s2)), pa.array(n[keep].astype(np.int32)), binary, pa.array(doc[keep]), pa.array(number[keep])]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "s1", "s2", "n", "prefix", "doc", "line"])

    rows = docs.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).cast("bigint").alias("_doc"), F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, "h bigint, s1 bigint, s2 bigint, n int, prefix binary, doc bigint, line int")


def _pieces(batch: pa.RecordBatch, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Whole rows of a batch, up to about ``size`` bytes of text at a time."""
    lengths = np.array([len(t) if (t := x.as_buffer()) else 0 for x in batch.column(1)], np.int64) if batch.num_rows else np.zeros(0, np.int64)
    start = held = 0
    for k, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _open_buckets(opened: DataFrame, bits: int = 32) -> np.ndarray:
    """The buckets of the open lines' prefix tokens, as a bitmap; for later rounds, which only need these lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{bits // 8}").astype(np.uint64) >> _U(bits - 22)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(found).astype(np.int64))], ["bucket"])

    return bitmap(opened.where("open").select("prefix").mapInArrow(run, "bucket bigint"))


def _list_lengths(sets: DataFrame, bits: int = 32) -> np.ndarray:
    """How long the posting lists of each bucket are at most, on the scale of ``_levels``, in a table of fixed size."""
    return token_levels(sets, "prefix", lambda prefixes: np.frombuffer(b"".join(prefixes), f"<u{bits // 8}").astype(np.uint64) << _U(64 - bits))


def _candidates(sets: DataFrame, rule: Rule, lengths, limit: int, parts: int, only=None, bits: int = 32, grouped: bool = False) -> DataFrame:
    """Earlier lines that may match a line that is ``open``: up to ``limit`` from each posting list, the closest signatures first.

    ``more`` tells that a list held further ones. ``lengths`` are those of :func:`_list_lengths`. With ``only``, lists outside these buckets are left out. The prefixes' tokens have
    so many ``bits``. If ``grouped``, ``open`` is a line's group, and lines of one group are not paired.
    """
    shards = 1 << max(3, int(np.ceil(np.log2(max(1, 2 * parts)))))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            order = np.argsort(columns[0])
            yield from blobs.in_rows(blobs.dealt("post", [c[order] for c in columns], columns[0][order], shards, plain=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            s1, s2, n, doc, line, open_ = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 5, 6, 7))
            raw = [np.frombuffer(p, f"<u{bits // 8}") for p in batch.column(4).to_pylist()]
            p = np.array([len(x) for x in raw])
            of, token = np.repeat(np.arange(len(raw)), p), np.concatenate(raw).astype(np.uint64)
            place = np.arange(len(of)) - np.repeat(np.cumsum(p) - p, p)
            if only is not None:
                wanted = marked(only.value, (token >> _U(bits - 22)).astype(np.int64))
                of, token, place = of[wanted], token[wanted], place[wanted]
            chunks = np.ceil(2.0 ** (lengths.value[(token >> _U(bits - 22)).astype(np.int64)] / 4.0) / LONG).astype(np.int64)
            own = (words.mixed_hash(s1.view(np.uint64), s2.view(np.uint64))[of] % np.maximum(chunks, 1).astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(of)), chunks)
            other = np.arange(len(again)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            low, high = np.minimum(own[again], other), np.maximum(own[again], other)
            key = words.mixed_hash(token[again], (low * 65_536 + high).astype(np.uint64))
            of, place = of[again], place[again]
            held.append([key, s1.view(np.uint64)[of], s2.view(np.uint64)[of], n[of].astype(np.uint64), place.astype(np.uint64), doc[of].view(np.uint64), line[of].astype(np.uint64), open_[of].astype(np.uint64)])
            size += len(of)
            if size >= GATHERED:
                yield from out()
                size = 0
        if size:
            yield from out()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for shard, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if shard != at and held:
                    yield from joined(held)
                    held = []
                at = shard
                held.append(blobs.unpacked(data, True))
        if held:
            yield from joined(held)

    def joined(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, s1, s2, n, place, doc, line, open_ = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        # One sort by list and size; lists whose keys are alike in 52 bits are read as one, which only adds candidates.
        mixed = (key & ~_U(4095)) | np.minimum(n, _U(4095))
        order = np.argsort(mixed)
        mixed, s1, s2, n, place, doc, line, open_ = (c[order] for c in (mixed, s1, s2, n.astype(np.int64), place.astype(np.int64), doc.view(np.int64), line, open_))
        key = mixed >> _U(12)
        if n.max() > 4095:
            order = np.lexsort((n, key))
            key, s1, s2, n, place, doc, line, open_ = (c[order] for c in (key, s1, s2, n, place, doc, line, open_))
        index = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])).astype(np.int64)
        scale = np.int64(n.max()) + 2
        # Partners of a posting are those after it in its list, up to the longest line that can match.
        last = np.searchsorted(index * scale + n, index * scale + np.minimum(rule.longest(n), scale - 1), "right")
        count = last - np.arange(len(n)) - 1
        edges = np.concatenate([[0], np.cumsum(count)])
        found: list[list[np.ndarray]] = []

        def out(a: np.ndarray, b: np.ndarray, apart: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
            sides = [pa.array(c) for x in (a, b) for c in (doc[x], line[x].astype(np.int32), s1[x].view(np.int64))]
            whole = pa.RecordBatch.from_arrays([*sides, pa.array(apart.astype(np.int32)), pa.array(more)], ["doc", "line", "s1", "doc0", "line0", "s10", "apart", "more"])
            yield from (whole.slice(k, HANDED) for k in range(0, whole.num_rows, HANDED))

        start = 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(edges, edges[start] + PAIRS, "right")) - 1)
            c = count[start:stop]
            if c.sum():
                i = np.repeat(np.arange(start, stop), c)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
                least = rule.least_overlap(n[i] + n[j])
                keep = np.minimum(n[i] - place[i], n[j] - place[j]) >= least  # nothing is shared before a pair's first common token
                i, j, least = i[keep], j[keep], least[keep]
                apart = (np.bitwise_count(s1[i] ^ s1[j]) + np.bitwise_count(s2[i] ^ s2[j])).astype(np.int64)
                keep = apart <= n[i] + n[j] - 2 * least
                i, j, apart = i[keep], j[keep], apart[keep]
                later = (doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j]))
                a, b = np.where(later, i, j), np.where(later, j, i)
                keep = open_[a] != open_[b] if grouped else open_[a] > 0
                keep &= (doc[i] != doc[j]) | (line[i] != line[j])  # lines of equal number in rows of equal ident are not earlier
                if keep.any():
                    found.append(best(a[keep], b[keep], apart[keep], np.zeros(int(keep.sum()), bool)))
                    if sum(len(f[0]) for f in found) > PAIRS:
                        found = [best(*(np.concatenate(x) for x in zip(*found)))]
                        if len(found[0][0]) > PAIRS // 2:  # a great limit lets few go; what is handed on early is ranked with all others later
                            yield from out(*found.pop())
            start = stop
        if found:
            yield from out(*best(*(np.concatenate(x) for x in zip(*found))))

    def best(a: np.ndarray, b: np.ndarray, apart: np.ndarray, more: np.ndarray) -> list[np.ndarray]:
        """The closest ``limit`` candidates of each posting; ``more`` where there were others."""
        order = np.lexsort((b, apart, a))
        a, b, apart, more = a[order], b[order], apart[order], more[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        size = np.diff(np.append(first, len(a)))
        rank = np.arange(len(a)) - np.repeat(first, size)
        more = np.repeat(np.logical_or.reduceat(more, first) | (size > limit), size)
        keep = rank < limit
        return [a[keep], b[keep], apart[keep], more[keep]]

    posts = sets.select("h", "s1", "s2", "n", "prefix", "doc", "line", "open").mapInArrow(post, blobs.SCHEMA)
    return posts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(match, "doc bigint, line int, s1 bigint, doc0 bigint, line0 int, s10 bigint, apart int, more boolean")


def bitmap(marks: DataFrame) -> np.ndarray:
    """The bits of the column of whole numbers below MARKS, eight in a byte; put together on the executors, so that the driver gets as many bytes as the bitmap has."""
    size = MARKS // 32

    def rows(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found:
            yield blobs.record_batch([("bits", s, zstandard.ZstdCompressor(level=1).compress(bits.tobytes())) for s, bits in found.items()])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(MARKS, bool)
        for batch in batches:
            held[batch.column(0).to_numpy(zero_copy_only=False)] = True
        yield from rows({s: np.packbits(part) for s in range(32) if (part := held[s * size : (s + 1) * size]).any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
                found[s] = found[s] | bits if s in found else bits
        yield from rows(found)

    out = np.zeros(MARKS // 8, np.uint8)
    for r in marks.mapInArrow(mark, blobs.SCHEMA).repartition(16, "shard").mapInArrow(add, blobs.SCHEMA).collect():
        at = r["shard"] * size // 8
        out[at : at + size // 8] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["data"])), np.uint8)
    return out


def marked(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return bits[marks >> 3] >> (7 - (marks & 7)).astype(np.uint8) & 1 > 0


def _mark(doc: F.Column, line: F.Column) -> F.Column:
    return F.pmod(F.pmod(doc, F.lit(MARKS)) * 1009 + line, F.lit(MARKS))


def _tokens(docs: DataFrame, ident: str, text: str, wanted: DataFrame) -> DataFrame:
    """The token sets of the lines ``wanted`` (and perhaps of some others), told by place and signature, from one more pass over the texts.

    Up to MARKED lines are found by a bitmap of fixed size; more are joined to the texts of their documents.
    """
    rows = docs.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).cast("bigint").alias("_doc"), F.col(text).cast("binary").alias("_text"))
    few = wanted.limit(MARKED + 1).count() <= MARKED
    if few:
        held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(_mark(F.col("doc"), F.col("line")).alias("m"))))
        own = wanted.select(F.col("doc").alias("_doc")).distinct()
        if own.limit(FEW + 1).count() <= FEW:
            rows = rows.join(F.broadcast(own), "_doc", "left_semi")
    else:
        rows = rows.join(wanted.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("line").alias("_lines")), "_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, number, chosen = [], [], []
            places = [None] * batch.num_rows if few else batch.column(2).to_pylist()
            for d, t, hit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), places):
                if few:
                    hit = np.flatnonzero(marked(held.value, (d % MARKS * 1009 + np.arange(t.count(b"\n") + 1)) % MARKS)).tolist()
                if len(hit):
                    lines = t.split(b"\n")
                    hit = [k for k in hit if k < len(lines)]
                    doc += [d] * len(hit)
                    number += hit
                    chosen += [lines[k] for k in hit]
            if doc:
                token, line, _, _ = scanned(chosen)
                order = np.lexsort((token, line))
                token, line = token[order], line[order]
                new = np.concatenate([[True], (line[1:] != line[:-1]) | (token[1:] != token[:-1])])[: len(token)]
                token, line = token[new], line[new]
                n = np.bincount(line, minlength=len(doc))
                first = np.cumsum(n) - n
                s1 = np.zeros(len(doc), np.uint64)
                if len(token):
                    s1[n > 0] = np.bitwise_xor.reduceat(_signature_bits(token)[0], first[n > 0])
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(s1.view(np.int64)), sets], ["doc", "line", "s1", "tokens"])

    return rows.mapInArrow(run, "doc bigint, line int, s1 bigint, tokens array<bigint>")


def kept_lines(docs: DataFrame, threshold: float = 0.8, least: int = 1, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident`` and ``kept``, the numbers (from 0) of a document's lines that match no earlier line.

    A line's tokens are the set of its words, A-Z lower-cased. Lines are in the order of ``ident`` and number; a line is removed if any earlier
    line, of any document and itself removed or not, has a Jaccard similarity of ``threshold`` or more. Documents of which every line with ``least``
    words, repeats included, is removed have no row. Lines of fewer words are not compared, and neither are rows of null ``ident`` or text.
    Lines of equal number in rows of equal ``ident`` are not earlier than one another; rows of equal ``ident`` share one row of the result, with
    every number whose line stays in one of them. An empty table gives an empty table.

    Equal sets meet in a grouped minimum, so copies of a line are never paired. Different sets meet in the posting lists of
    their prefix tokens, are filtered there, and the closest candidates of each line are verified on the sets themselves. The
    lines without a verified match that had more candidates go into another round with more.
    """
    spark, rule = docs.sparkSession, Rule(threshold)
    shared.ready_workers(spark)
    held = spark.sparkContext.broadcast(token_levels(docs, text))
    parts = docs.rdd.getNumPartitions()
    sets = _line_sets(docs, ident, text, rule, least, held).groupBy("h", "s1", "s2", "n", "prefix").agg(F.min(F.struct("doc", "line")).alias("_at"))
    sets = shared.cut(sets.select("h", "s1", "s2", "n", "prefix", "_at.doc", "_at.line"))
    lengths = spark.sparkContext.broadcast(_list_lengths(sets))
    opened, matched, only, limit = sets.withColumn("open", F.lit(True)), None, None, FIRST
    own, earlier = ["doc", "line", "s1"], ["doc0", "line0", "s10"]
    while True:
        pairs = _candidates(opened, rule, lengths, limit, parts, only).groupBy(*own, *earlier).agg(F.min("apart").alias("apart"), F.max("more").alias("more"))
        whole = W.partitionBy(*own)
        pairs = pairs.withColumns({"rank": F.row_number().over(whole.orderBy("apart", *earlier)), "size": F.count(F.lit(1)).over(whole), "more": F.max("more").over(whole)})
        pairs = pairs.where(F.col("rank") <= limit).withColumn("more", F.col("more") | (F.col("size") > limit))
        pairs = shared.cut(pairs.select(*own, *earlier, "more"))
        wanted = shared.cut(pairs.select("doc", "line").union(pairs.select(F.col("doc0").alias("doc"), F.col("line0").alias("line"))).distinct())
        tokens = shared.cut(_tokens(docs, ident, text, wanted).dropDuplicates(own))
        a, b = tokens.withColumnRenamed("tokens", "a"), tokens.select(*(F.col(x).alias(y) for x, y in zip(own, earlier)), F.col("tokens").alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        similar = both * rule.t.denominator >= (F.size("a") + F.size("b") - both) * rule.t.numerator
        judged = shared.cut(pairs.join(a, own).join(b, earlier).groupBy(*own).agg(F.max(similar).alias("similar"), F.max("more").alias("more")))
        hit = judged.where("similar").select(*own)
        matched = hit if matched is None else matched.union(hit)
        left = judged.where("more and not similar").select(*own)
        if left.isEmpty():
            break
        limit *= MORE
        opened = sets.join(left.withColumn("open", F.lit(True)), own, "left").withColumn("open", F.coalesce("open", F.lit(False)))
        only = spark.sparkContext.broadcast(_open_buckets(opened))
    kept = sets.select(*own).join(matched, own, "left_anti")
    return kept.groupBy(F.col("doc").alias(ident)).agg(F.array_sort(F.collect_set("line")).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = 0.8, least: int = 1, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the lines that :func:`kept_lines` removes taken out of the text; all else stays as it is.

    Lines without words and lines of fewer than ``least`` words, repeats included, stay, so a document may keep blank lines only. No document is dropped.
    """
    number, stay_here = (shared.fresh(docs.columns, c) for c in ("_doc", "_kept"))
    kept = kept_lines(docs, threshold, least, ident, text).select(F.col(ident).cast("bigint").alias(number), F.col("kept").alias(stay_here))
    joined = docs.join(kept, F.col(ident).cast("bigint") == F.col(number), "left").select(*docs.columns, stay_here)
    at, names, kinds = docs.columns.index(text), docs.columns, dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        idents, texts, numbers = batch.column(names.index(ident)).to_pylist(), batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
        out = []
        for d, t, k in zip(idents, texts, numbers):
            if t and d is not None:
                stay = set(k or ())
                t = "\n".join([line for n, line in enumerate(t.split("\n")) if n in stay or len(line.encode().split()) < least])
            out.append(t)
        arrays = [*batch.columns[:-1]]
        arrays[at] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays(arrays, names)

    return words.map_batches(joined, run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
