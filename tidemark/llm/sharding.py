"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import ranks

#: Pieces of the unit interval over which fractional ranks are sorted.
SLICES = 4096


def interleaved(rows: DataFrame, shards: int = 8, stratum: str = "source", ident: str = "doc_id", seed: int = 17, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, without gaps) to every row.

    Rows of each stratum are shuffled by a seeded hash of ``ident`` and ranked; row r (from 0) of a stratum of n rows has the fractional
    rank (2r + 1) / 2n. All rows are sorted by it, then by stratum and hash, and the sequence is cut into shards whose row
    counts differ by one at most. In every run of that sequence each stratum has its share of the rows, to within one row, so
    every shard matches the mixture.

    A null stratum is a stratum of its own. Rows of equal ``ident`` are ordered by ``ties``; rows equal in these too are
    interchangeable. An empty table gives an empty table. Columns of the input stay, whatever they are called, except that
    ``shard`` and ``slot`` are replaced.
    """
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    slim = rows.select(
        F.struct(*own).alias("_row"),
        ranks.group_key(stratum).alias("_stratum"),
        ranks.seeded_key(seed, ident).alias("_key"),
        F.col(ident).alias("_ident"),
        *(F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)),
    )
    after = ["_ident", *(f"_tie{i}" for i in range(len(ties)))]
    places = (
        ranks.ranked(slim, "_stratum", "_key", after)
        .withColumn("_fraction", (2 * F.col("rank") + 1) / (2 * F.col("group_n")))
        .withColumn("_slice", F.least(F.floor(F.col("_fraction") * SLICES), F.lit(SLICES - 1)).cast("int"))
    )
    ordered = W.orderBy("_slice")
    offsets = (
        places.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_n"))  # SLICES rows at most, so that the windows without a key are small
        .select("_slice", F.coalesce(F.sum("_n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    )
    place = F.col("_first") + F.row_number().over(W.partitionBy("_slice").orderBy("_fraction", "_stratum", "_key", *after)) - 1
    return (
        places.join(offsets, "_slice")
        .withColumn("_place", place)
        .withColumn("_shard", F.expr(f"_place * {shards}L div _all"))
        .select("_row.*", F.col("_shard").cast("int").alias("shard"), (F.col("_place") - F.expr(f"(_shard * _all + {shards - 1}L) div {shards}L")).cast("bigint").alias("slot"))
    )
