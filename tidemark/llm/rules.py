"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio of a trusted target over the raw corpus.

DataFrame expressions only. Columns that lambdas index are made in a projection of their own and are referred to more than once, which keeps the
optimizer from copying their expression into the lambda.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared

#: ASCII white space between words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Bits of an n-gram's bucket: the table has 2**BITS entries, whatever the corpus.
BITS = 18
#: Types of identifiers that are taken together, and rows of trusted identifiers that are broadcast at most.
INTEGERS, SENT = {"tinyint", "smallint", "int", "bigint"}, 1 << 20
#: Added to every bucket's count; and micro-nats, in which ratios are whole numbers and sums exact.
SMOOTH, UNIT = 0.5, 1_000_000
#: Words of a window that counts as repeated, least words, and the percentage of repeated words that fails a text.
WINDOW, LEAST_WORDS, REPEATED = 5, 10, 20
#: The least mean ratio, in nats an n-gram, of a text that is kept.
THRESHOLD = -0.25


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _gram_buckets(h: str) -> Column:
    """Buckets of the unigrams and bigrams of the word hashes ``h``: the leading bits of a hash."""
    top = 64 - BITS
    one = F.transform(h, lambda x: F.shiftrightunsigned(x, top))
    two = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.shiftrightunsigned(F.xxhash64(F.get(h, i), x), top))
    return F.concat(one, two)


def _hashed(docs: DataFrame, text: str, *own: Column) -> DataFrame:
    """The columns ``own`` with the words and the word hashes of the text."""
    split = docs.select(*own, F.col(text).alias("_text"), words_of(F.col(text)).alias("_words"))
    return split.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"))


def _marked(docs: DataFrame, trusted: DataFrame, ident: str, text: str) -> DataFrame:
    """The texts with ``_target``, 1 for those whose ``ident`` is in ``trusted``, else 0.

    Whole numbers are taken together, those that differ in the last six bits as one row with a mask. Up to ``SENT`` rows are broadcast, and the texts stay where
    they are; more are joined by a shuffle of the texts.
    """
    numbers = {dict(df.dtypes)[ident] for df in (docs, trusted)} <= INTEGERS
    number = F.col(ident).cast("bigint")
    place = F.shiftright(number, 6) if numbers else F.col(ident)
    bit = number.bitwiseAND(63).cast("int") if numbers else F.lit(0)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    chosen = shared.cut(trusted.where(F.col(ident).isNotNull()).groupBy(place.alias("_place")).agg(F.bit_or(one).alias("_mask")))
    held = F.broadcast(chosen) if chosen.count() <= SENT else chosen
    joined = docs.select(F.col(text), place.alias("_place"), bit.alias("_bit")).join(held, "_place", "left")
    return joined.select(text, F.coalesce(F.call_function("getbit", "_mask", "_bit").cast("int"), F.lit(0)).alias("_target"))


def ratios(docs: DataFrame, trusted: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket`` and ``ratio``, the log of its share in the target over its share in the corpus, in micro-nats; 2**BITS rows.

    The corpus is every row of ``docs``, the target every row whose ``ident`` is in ``trusted``. The texts are met in one scan.
    """
    grams = _hashed(_marked(docs, trusted, ident, text), text, F.col("_target")).select("_target", F.explode(_gram_buckets("_h")).alias("bucket"))
    counts = shared.cut(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_target").alias("target")))
    whole = docs.sparkSession.range(1 << BITS).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    n = float(SMOOTH * (1 << BITS))
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("target"), F.lit(0)).alias("t")).first()  # two numbers
    even = float(log((sums["r"] + n) / (sums["t"] + n)))
    ratio = F.round((F.log((F.col("target") + SMOOTH) / (F.col("raw") + SMOOTH)) + F.lit(even)) * UNIT).cast("bigint")
    return whole.select("bucket", (ratio if sums["t"] else F.lit(0).cast("bigint")).alias("ratio"))


def judged(docs: DataFrame, table: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The counts, ``base_failed``, ``llr`` (nats an n-gram) and ``kept`` of every whole text; null counts as empty.

    ``n_words`` and ``word_chars`` count words and their code points, ``n_symbols`` the symbols, ``n_dup_lines`` the lines with a word that equal an
    earlier one, ``n_repeat_words`` the words inside a window of five words that the text holds twice or more. Windows are told by
    64-bit hashes. A text fails the base rules with fewer than ten words or more than a fifth of them repeated; it is kept if it passes
    them and its n-grams' mean ratio is ``threshold`` or more. The ratio of a text without words is 0.
    """
    numbered = docs.select(F.col(ident).alias("_id"), F.col(text), F.monotonically_increasing_id().alias("_row"))
    first = _hashed(numbered, text, F.col("_id"), F.col("_row"))
    lines = F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("_h", i + k) for k in range(1, WINDOW))))
    second = first.select(
        "_id", "_row",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.when(F.col("_text").rlike(SYMBOLS), F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).otherwise(0).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
        windows.alias("_windows"),
        _gram_buckets("_h").alias("_grams"),
    )
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.when(again, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    third = second.select(
        "_id", "_row", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        ordered.alias("_ordered"),
        "_grams",
    )
    same = lambda s, k: F.coalesce(F.get("_ordered", k)["x"] == s["x"], F.lit(False))
    repeated = F.filter("_ordered", lambda s, k: same(s, k - 1) | same(s, k + 1))
    fourth = third.select("*", F.sort_array(F.transform(repeated, lambda s: s["i"])).alias("_places"))
    spread = F.transform("_places", lambda p, k: F.least(F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    repeats = F.coalesce(F.aggregate(spread, F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(0).cast("bigint"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fifth = fourth.select("_row", "_id", *counts[:-1], repeats.alias(counts[-1]), "_grams")  # below the rows of n-grams, so once a text
    # A row for each n-gram meets the table, of fixed size, and is summed up again inside the task: only a row for each text is shuffled.
    grams = fifth.select("_row", "_id", *counts, F.explode_outer("_grams").alias("bucket"))
    summed = grams.join(F.broadcast(table), "bucket", "left").groupBy("_row", "_id").agg(*(F.max(c).alias(c) for c in counts), F.coalesce(F.sum("ratio"), F.lit(0)).alias("_sum"), F.count("bucket").alias("_n"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    passed = F.col("_sum") >= F.col("_n") * F.lit(round(threshold * UNIT)).cast("bigint")
    llr = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n") / UNIT).otherwise(0.0)
    return summed.select(F.col("_id").alias(ident), *counts, failed.alias("base_failed"), (~failed & passed).alias("kept"), llr.alias("llr"))


def rules(docs: DataFrame, trusted: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """:func:`judged` by the :func:`ratios` of the trusted rows; without any, all ratios are 0 and the base rules decide alone."""
    return judged(docs, ratios(docs, trusted, ident, text), ident, text, threshold)
