"""Places and running sums in long series, without a task that holds a whole series.

A series is cut into pieces of time. Only a piece is sorted in one task; a small table of the pieces' counts and sums gives each piece what comes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a piece.
SPAN = 3600


def pieces(df: DataFrame, order: list[str], span: int = SPAN) -> Column:
    """The piece of a row by the first column of its order: a number that does not fall along the order. Null times are a piece before all others."""
    kind = dict(df.dtypes)[order[0]]
    if kind in ("timestamp", "timestamp_ntz"):
        us = F.unix_micros(F.col(order[0]).cast("timestamp"))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        us = F.col(order[0]).cast("bigint") * 1_000_000
    else:
        return F.lit(0).cast("bigint")
    return F.coalesce(F.floor(us / (span * 1_000_000)), F.lit(-(1 << 62)))


def along(keys: list[str], order: list[str]) -> W:
    """The rows of a piece up to the current one."""
    return W.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def placed(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``_i``, a row's place from 1 in its series, ``_n``, the rows of the series, and a running sum for each of ``sums``."""
    sums = sums or {}
    cut = df.withColumn("_piece", pieces(df, order))
    totals = cut.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)),
        F.col("_piece").alias("_of"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
        F.sum("_rows").over(W.partitionBy(*keys)).alias("_n"),
        *(F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_sum0_{k}") for k in sums),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    met = cut.withColumns({"_i": F.row_number().over(along(keys, order)), **{k: F.sum(c).over(along(keys, order)) for k, c in sums.items()}})
    met = met.join(offsets, [*same, F.col("_piece") == F.col("_of")])
    return met.withColumns({"_i": F.col("_i") + F.col("_rows0"), **{k: F.coalesce(F.col(k), F.lit(0)) + F.col(f"_sum0_{k}") for k in sums}}).select(*df.columns, "_i", "_n", *sums)
