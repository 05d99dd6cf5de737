"""The queries opN_ and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, kneser_ney, langid, linedup, mixing, oracles, quality, rules, sharding, simhash, vecdup

#: Domains of the sources, and the weights of domains and languages. Other values weigh OTHER.
DOMAINS = {"web": [0], "books": [1, 2, 3, 4], "news": [5, 6, 7, 8, 9], "forums": list(range(10, 20))}
WEIGHTS = {"domain": {"web": 0.35, "books": 0.25, "news": 0.25, "forums": 0.15}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}
OTHER = 0.05
SHARE, EPOCHS = 0.6, 2
#: Words of the language model's n-grams.
ORDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain():
    """The domain of a source."""
    column = F.lit("other")
    for name, numbers in DOMAINS.items():
        column = F.when(F.col("source").isin([f"src{n}" for n in numbers]), name).otherwise(column)
    return column


def levels() -> dict:
    return {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}


def fold(n: int):
    """The remainder of a document's number by n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def held_out(n: int):
    """Whether the remainder is 0; false for a document without number, from which nothing is learned either."""
    return F.coalesce(fold(n) == 0, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs, fold(5) != 0))
    return found.select("doc_id", held_out(5), "lang_pred", "score", "ambiguous", "runner_up")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal labels, linked at a cosine of 0.93 or more."""
    return vecdup.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of four folds of five."""
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    found = quality.scored(docs.select("doc_id", "text"), model, 0.3)
    return found.select("doc_id", held_out(5), "score", "predicted", "difference")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, budget=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of every document; the trusted target are the documents labelled 1."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rules.rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the 50k vocabulary and what they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under a model of nine folds of ten."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = kneser_ney.scored(docs, kneser_ney.train(docs, fold(10) != 0, order=ORDER))
    return found.select("doc_id", held_out(10), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: shards of equal counts by proportional stratified interleaving of the sources."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.interleaved(docs, shards=8, ties=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of epochs that take it into the mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.word_count().alias("n_words"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    chosen = mixing.mixed(docs, levels(), WEIGHTS, SHARE, EPOCHS, tokens=F.col("n_words"), ties=("text_crc32",), default=OTHER)
    return chosen.select("doc_id", domain().alias("domain"), "lang", "source", "n_tokens", "leaf_tokens", "leaf_budget", "copies")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that match no earlier line at a Jaccard similarity of 0.8.

    ``kept_lines`` are the numbers of those of a row's lines with a word that stay; ``n_removed`` counts the others. All lines of a row without number
    stay. Of rows of equal number, a line's number stays in all of them if it stays in one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linedup.kept_lines(docs, 0.8)
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, n: F.when(line.rlike(mixing.WORD), n))
    found = docs.select("doc_id", F.array_compact(lines).alias("wordy")).join(kept, "doc_id", "left")
    stay = F.when(F.col("doc_id").isNull(), F.col("wordy")).otherwise(F.array_intersect("wordy", F.coalesce("kept", F.array().cast("array<int>"))))
    n_lines, n_kept = F.size("wordy").cast("bigint"), F.size("stay").cast("bigint")
    rows = found.select("doc_id", "wordy", stay.alias("stay"))
    return rows.select("doc_id", n_lines.alias("n_lines"), n_kept.alias("n_kept"), (n_lines - n_kept).alias("n_removed"), F.concat_ws(",", F.col("stay").cast("array<string>")).alias("kept_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_embedding_dedup, op3_simhash, op4_quality, op5_quality_rules, op6_byte_bpe, op7_lm_scoring, op8_sharding, op9_mixing, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    """SQL has no way to train a classifier or a model, to split text for BPE, or to hash by XXH64; tests hold those queries against brute force."""
    return {
        "op2_embedding_dedup": oracles.embedding_dedup(0.93),
        "op8_sharding": oracles.sharding(),
        "op9_mixing": oracles.mixing(DOMAINS, WEIGHTS, OTHER, SHARE, EPOCHS),
        "op10_line_dedup": oracles.line_dedup(),
    }
