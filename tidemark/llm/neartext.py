"""Near duplicates at a Jaccard similarity of word shingles: SimHash gives the first candidates, a set-similarity join all others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import graph, linedup, shared, simhash, words

#: Candidates that a text gets from each posting list in the join's first round; each further one takes MORE times as many, between texts not yet in one group.
FIRST, MORE = 8, 64

_U = np.uint64


def shingles(texts: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle of the texts, repeats included, and its text's place; a shorter text is one shingle, a text without words has none."""
    token, count = words.text_words(texts)
    width = np.minimum(count, shingle)
    made = np.where(count > 0, count - width + 1, 0)
    place = np.repeat(np.arange(len(made)), made)
    at = np.repeat(np.cumsum(count) - count, made) + np.arange(len(place)) - np.repeat(np.cumsum(made) - made, made)
    out = token[at]
    for k in range(1, shingle):
        more = width[place] > k
        out[more] = words.mixed_hash(out[more], token[at[more] + k])
    return out, place


def _numbered(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.where(F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias("doc"), F.col(text).cast("binary").alias("_text"))


def _sets(docs: DataFrame, ident: str, text: str, shingle: int, rule: linedup.Rule, levels) -> DataFrame:
    """Every text's hash of its shingle set, parity signature, size and prefix of rare shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in linedup._pieces(whole):
                token, place = shingles(batch.column(1).to_pylist(), shingle)
                size = batch.num_rows
                n, total, s1, offsets, prefix = np.zeros(size, np.int64), np.zeros(size, _U), np.zeros(size, _U), np.zeros(size + 1, np.int32), np.zeros(0, "<u8")
                if len(token):
                    place, token = linedup._ordered(place, token, levels.value)
                    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    held = place[first]
                    n[held] = np.diff(np.append(first, len(place)))
                    mixed = words.mixed_hash(token, np.full(len(token), 77, _U))
                    total[held] = np.add.reduceat(mixed, first)
                    s1[held] = np.bitwise_xor.reduceat(_U(1) << (mixed & _U(63)), first)
                    p = np.zeros(size, np.int64)
                    p[held] = rule.prefix(n[held])
                    at = np.repeat(first, p[held]) + np.arange(p.sum()) - np.repeat((np.cumsum(p) - p)[held], p[held])
                    prefix, offsets[1:] = token[at].astype("<u8"), 8 * np.cumsum(p)
                binary = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(prefix.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total.view(np.int64)), pa.array(s1.view(np.int64)), pa.array(n.astype(np.int32)), binary], ["doc", "h", "s1", "n", "prefix"])

    return _numbered(docs, ident, text).mapInArrow(run, "doc bigint, h bigint, s1 bigint, n int, prefix binary")


def _verified(docs: DataFrame, ident: str, text: str, shingle: int, rule: linedup.Rule, pairs: DataFrame) -> DataFrame:
    """Of the ``pairs`` (a, b), those whose sets have the similarity, from one more pass over the texts."""
    wanted = shared.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    few = wanted.limit(linedup.MARKED + 1).count() <= linedup.MARKED
    held = docs.sparkSession.sparkContext.broadcast(linedup.bitmap(wanted.select(F.pmod("doc", F.lit(linedup.MARKS)).alias("m"))) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if few:
                whole = whole.filter(pa.array(linedup.marked(held.value, whole.column(0).to_numpy(zero_copy_only=False) % linedup.MARKS)))
            for batch in linedup._pieces(whole):
                token, place = shingles(batch.column(1).to_pylist(), shingle)
                order = np.lexsort((token, place))
                token, place = token[order], place[order]
                new = np.concatenate([[True], (place[1:] != place[:-1]) | (token[1:] != token[:-1])])[: len(token)]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(place[new], minlength=batch.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(token[new].view(np.int64)))], ["doc", "tokens"])

    rows = _numbered(docs, ident, text)
    # Few texts are picked out in the scan by a bitmap of fixed size; of more, whole texts meet their numbers in a join.
    rows = rows if few else rows.join(wanted, "doc", "left_semi")
    tokens = rows.mapInArrow(run, "doc bigint, tokens array<bigint>")
    tokens = shared.cut((tokens.join(wanted, "doc", "left_semi") if few else tokens).dropDuplicates(["doc"]))
    own, other = (tokens.select(F.col("doc").alias(c), F.col("tokens").alias(f"_{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("_a", "_b"))
    similar = both * rule.t.denominator >= (F.size("_a") + F.size("_b") - both) * rule.t.numerator
    return pairs.join(own, "a").join(other, "b").where(similar).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, ident: str = "doc_id", text: str = "text", shingle: int = 5, budget: int = 4) -> DataFrame:
    """``ident`` and ``component_id``, the smallest ``ident`` reachable by shingle sets of a Jaccard similarity of ``threshold`` or more.

    Equal sets are one class, and so are texts without words. Classes are paired by fingerprints within ``budget`` bits first, which takes few pairs of a large
    group; then by the rare shingles that any similar pair shares, which finds every other pair. Each pair is verified on the sets. Further rounds leave
    out pairs that are in one group already, and a posting list gives each text FIRST candidates, then ever more. Rows of null ``ident`` have no row; of rows of equal
    ``ident`` with different texts, each belongs to its own class, and one of them is verified for all.
    """
    spark, rule = docs.sparkSession, linedup.Rule(threshold)
    shared.ready_workers(spark)
    held = spark.sparkContext.broadcast(linedup.token_levels(docs, text, lambda texts: shingles(texts, shingle)[0]))
    parts = docs.rdd.getNumPartitions()
    found = shared.cut(_sets(docs, ident, text, shingle, rule, held))
    sets = shared.cut(found.groupBy("h", "n").agg(F.min("doc").alias("doc"), F.min_by("s1", "doc").alias("s1"), F.min_by("prefix", "doc").alias("prefix")))
    prints = simhash.fingerprints(docs.where(F.col(ident).isNotNull()), ident, text, shingle).select(F.col(ident).cast("bigint").alias("doc"), "fp")
    prints = shared.cut(prints.join(sets.where("n > 0").select("doc"), "doc", "left_semi"))
    distinct = shared.cut(prints.groupBy("fp").agg(F.min("doc").alias("rep")))
    equal = prints.join(distinct, "fp").where("doc > rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    near = simhash.hamming_links(distinct, budget, distinct.count()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = shared.cut(_verified(docs, ident, text, shingle, rule, shared.cut(equal.union(near).distinct())))
    lists, only, limit = sets.where("n > 0").withColumn("s2", F.lit(0).cast("bigint")).withColumn("line", F.lit(0)), None, FIRST
    lengths = spark.sparkContext.broadcast(linedup._list_lengths(lists, 64))
    while True:
        groups = graph.components(links, "a", "b")
        grouped = lists.join(groups, F.col("doc") == F.col("node"), "left").withColumn("open", F.coalesce("component", "doc"))
        pairs = linedup._candidates(grouped, rule, lengths, limit, parts, only, bits=64, grouped=True)
        pairs = shared.cut(pairs.groupBy(F.col("doc").alias("a"), F.col("doc0").alias("b")).agg(F.max("more").alias("more")))
        if not pairs.isEmpty():
            links = shared.cut(links.union(_verified(docs, ident, text, shingle, rule, pairs.select("a", "b"))))
        left = pairs.where("more").select(F.col("a").alias("doc")).distinct()
        if left.isEmpty():
            break
        limit *= MORE
        only = spark.sparkContext.broadcast(linedup._open_buckets(lists.join(left, "doc", "left_semi").withColumn("open", F.lit(True)), bits=64))
    groups = graph.components(links, "a", "b")
    classes = sets.join(groups, F.col("doc") == F.col("node"), "left").select("h", "n", F.coalesce("component", "doc").alias("component_id"))
    return found.join(classes, ["h", "n"]).select(F.col("doc").cast(dict(docs.dtypes)[ident]).alias(ident), "component_id")
