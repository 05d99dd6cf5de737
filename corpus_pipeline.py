"""A training-data pipeline: each stage works on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of ``documents`` from all but the last.
The last returns, for every document of the mixture, its number, its token ids and their count.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import bpe, linedup, mixing, neartext, quality, queries, shared

#: A document is rejected below this chance of a good label.
QUALITY = 0.3
#: A line is removed at this Jaccard similarity to an earlier one; lines of fewer words, repeats included, are left alone.
SIMILAR, LEAST_WORDS = 0.8, 5
#: Words of a shingle, the Jaccard similarity of near duplicates' shingle sets, and bits that may differ between the first candidates.
SHINGLE, NEAR, BITS = 5, 0.8, 4
#: The mixture's share of the tokens that are left, and how often a document may be taken.
SHARE, EPOCHS = 0.9, 1


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns from the labelled rows of four folds of five."""
    model = quality.learn(docs, queries.table(spark, sf_dir, "labels"), queries.fold(5) != 0)
    called = tuple(shared.fresh(docs.columns, c) for c in ("_difference", "_score", "_predicted"))
    return quality.scored(docs, model, QUALITY, whole=True, called=called).where(F.col(called[2]) == 1).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that match an earlier line; ``n_chars`` follows the text."""
    found = linedup.deduplicated(docs, SIMILAR, LEAST_WORDS)
    return found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else found


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest number of each group of near duplicates; of rows of equal number one stays, those without number all stay."""
    groups = neartext.near_duplicates(docs, NEAR, shingle=SHINGLE, budget=BITS)
    stay = groups.where(F.col("doc_id").cast("bigint") == F.col("component_id")).select("doc_id").distinct()
    numbered = docs.where("doc_id is not null").join(stay, "doc_id", "left_semi")
    return numbered.dropDuplicates(["doc_id"]).union(docs.where("doc_id is null")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights, each at most once.

    A row is told by its number and a hash of its text, language and source, also without a number; of rows equal in these, so many stay as are taken.
    """
    own, taken, place = (shared.fresh(docs.columns, c) for c in ("_own", "_taken", "_place"))
    row = F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.isnull("text"))
    slim = docs.select("doc_id", "lang", "source", mixing.word_count().alias("_words"), row.alias("_tie"))
    chosen = mixing.mixed(slim, queries.levels(), queries.WEIGHTS, SHARE, EPOCHS, tokens=F.col("_words"), ties=("_tie",), default=queries.OTHER)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    found = chosen.where("copies > 0").groupBy(F.xxhash64(number, F.col("_tie")).alias(own)).agg(F.count(F.lit(1)).alias(taken))
    met = docs.withColumn(own, F.xxhash64(number, row)).join(found, own)
    return met.withColumn(place, F.row_number().over(W.partitionBy(own).orderBy(F.lit(0)))).where(F.col(place) <= F.col(taken)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number, language, source, token ids and their count of every document, and a check that they decode to its text."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encoded_rows(docs.select("doc_id", "lang", "source", "text"), path, pattern)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("simhash near-dedup", simhash_dedup), ("mixing", mix_sources), ("byte-level BPE", encode)]

#: Compression, the line join, fingerprints and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder as Parquet and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        folder = f"{shared.new_folder(spark, 'pipeline')}/{k}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
