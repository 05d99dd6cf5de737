"""Exact ranks and running sums inside groups of any size, without a task that holds a whole group.

Rows are ordered inside a group by a hexadecimal hash. Its leading digits cut each group into ``BUCKETS`` pieces of
nearly equal size; a small table of counts and weights of the pieces gives each piece its offset, and only a piece is
ever sorted in one task. A hot group is thus spread over as many tasks as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Pieces of a group.
BUCKETS = 1024


def group_key(column: str) -> Column:
    """A column as a grouping key that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def seeded_key(seed: int | str, *columns: str) -> Column:
    """The hexadecimal hash that shuffles rows: MD5 of the seed and the columns, null as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def ranked(df: DataFrame, group: str, key: str, ties: list[str], weight: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 0), ``before`` (weight of the rows before), ``group_n`` and ``group_weight``.

    ``group`` holds no null; ``key`` is a hexadecimal hash; ``ties`` order rows of equal keys.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(0).cast("bigint")
    cut = df.withColumn("_piece", F.floor(F.conv(F.substring(key, 1, 5), 16, 10).cast("bigint") * BUCKETS / (1 << 20)).cast("int"))
    pieces = cut.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
    earlier = W.partitionBy(group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(group)
    offsets = pieces.select(
        group,
        "_piece",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rank0"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_before0"),
        F.sum("_n").over(whole).alias("group_n"),
        F.sum("_w").over(whole).alias("group_weight"),
    )
    inside = W.partitionBy(group, "_piece").orderBy(key, *ties)
    return (
        cut.join(offsets, [group, "_piece"])
        .withColumn("rank", F.col("_rank0") + F.row_number().over(inside) - 1)
        .withColumn("before", F.col("_before0") + F.coalesce(F.sum(w).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .drop("_piece", "_rank0", "_before0")
    )
