"""Range functions: every sample looks back over its own series.

Each takes a DataFrame with ``labels``, ``ts`` and ``value``, whose rows begin one range before the query's start, and returns the same columns. Samples of
one series at one time are in the order of their values.

No function needs a whole series in one task. Time is cut into blocks of BLOCK ranges; rows of the last range of a block are also given to the next one, so that each block
holds every range that ends in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.model import micros, series_key

_SERIES, _US, _BLOCK, _OWN = "_series", "_us", "_block", "_own"
#: Ranges in a block: one row in so many is copied.
BLOCK = 4


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({_SERIES: series_key(), _US: micros()})


def _at() -> Column:
    """A sample's place in its series: compared by time, then by value."""
    return F.struct(F.col(_US).alias("us"), F.col("value").alias("v"))


def _placed(df: DataFrame, size: int) -> DataFrame:
    """The rows with their block, and whether the next block needs them too."""
    length = BLOCK * size
    start = F.col(_US) - F.pmod(F.col(_US), F.lit(length))
    return keyed(df).withColumns({_BLOCK: F.expr(f"(_us - pmod(_us, {length}L)) div {length}L"), "_tail": F.col(_US) - start >= length - size})


def in_blocks(df: DataFrame, size: int) -> DataFrame:
    """The rows by series and block, with copies (not ``_own``) of those that the block after theirs looks back on."""
    placed = _placed(df, size)
    copies = F.when(F.col("_tail"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = placed.select("labels", "ts", "value", _SERIES, _US, _BLOCK, F.explode(copies).alias("_later"))
    return spread.select("labels", "ts", "value", _SERIES, _US, (F.col(_BLOCK) + F.col("_later")).alias(_BLOCK), (F.col("_later") == 0).alias(_OWN))


def _window() -> W:
    return W.partitionBy(_SERIES, _BLOCK).orderBy(_US)


def rate(df: DataFrame, size: int) -> DataFrame:
    """Increase a second over a range of ``size`` microseconds, as the compatible language defines it.

    With c = t - ``size``, a sample's baseline is the last sample strictly before c, or the first of the series if that is exactly at c; without a
    baseline there is no result. The value is the difference over the whole range, and 0 where it would be negative.

    The baseline is in the sample's own block, or among the copies of the block before, or the last sample of all before these; that comes from a
    table of one row a block.
    """
    blocks = _placed(df, size).groupBy(_SERIES, _BLOCK).agg(F.max(_at()).alias("_all"), F.max(F.when(~F.col("_tail"), _at())).alias("_head"), F.min(_at()).alias("_first"))
    order = W.partitionBy(_SERIES).orderBy(_BLOCK)
    earlier = F.greatest(F.max("_all").over(order.rangeBetween(W.unboundedPreceding, -2)), F.max("_head").over(order.rangeBetween(-1, -1)))
    ends = blocks.select(_SERIES, _BLOCK, earlier.alias("_carry"), F.min("_first").over(W.partitionBy(_SERIES)).alias("_origin"))
    near = in_blocks(df, size).withColumn("_near", F.max(_at()).over(_window().rangeBetween(W.unboundedPreceding, -(size + 1))))
    met = near.where(_OWN).join(ends, [_SERIES, _BLOCK])
    first = F.when(F.col("_origin.us") == F.col(_US) - size, F.col("_origin.v"))
    based = met.withColumn("_base", F.coalesce(F.col("_near.v"), F.col("_carry.v"), first))
    return based.where("_base is not null").select("labels", "ts", F.greatest(F.lit(0.0), (F.col("value") - F.col("_base")) / (size / 1e6)).alias("value"))


def rate_by_series(df: DataFrame, size: int) -> DataFrame:
    """:func:`rate` with each series in one task: one shuffle less, for many short series."""
    series = W.partitionBy(_SERIES).orderBy(_US)
    whole = series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = keyed(df).withColumns({"_near": F.max(_at()).over(series.rangeBetween(W.unboundedPreceding, -(size + 1))), "_origin": F.min(_at()).over(whole)})
    based = rows.withColumn("_base", F.coalesce(F.col("_near.v"), F.when(F.col("_origin.us") == F.col(_US) - size, F.col("_origin.v"))))
    return based.where("_base is not null").select("labels", "ts", F.greatest(F.lit(0.0), (F.col("value") - F.col("_base")) / (size / 1e6)).alias("value"))


def increase(df: DataFrame, size: int) -> DataFrame:
    """The rate times the range in seconds."""
    return rate(df, size).withColumn("value", F.col("value") * (size / 1e6))


def _over(function: Callable[[Column], Column]) -> Callable[[DataFrame, int], DataFrame]:
    def apply(df: DataFrame, size: int) -> DataFrame:
        window = _window().rangeBetween(-(size - 1), 0)  # a range is open at its start
        return in_blocks(df, size).withColumn("_out", function(F.col("value")).over(window).cast("double")).where(_OWN).select("labels", "ts", F.col("_out").alias("value"))

    return apply


def _pair(function: Callable[[Column, Column, Column], Column]) -> Callable[[DataFrame, int], DataFrame]:
    """Functions of the last two samples of the range: values before and now, and the seconds between."""

    def apply(df: DataFrame, size: int) -> DataFrame:
        order = W.partitionBy(_SERIES, _BLOCK).orderBy(_US, "value")
        rows = in_blocks(df, size).withColumns({"_v0": F.lag("value").over(order), "_u0": F.lag(_US).over(order)})
        rows = rows.where(F.col(_OWN) & (F.col("_u0") > F.col(_US) - size) & (F.col("_u0") < F.col(_US)))
        return rows.select("labels", "ts", function(F.col("_v0"), F.col("value"), (F.col(_US) - F.col("_u0")) / 1e6).alias("value"))

    return apply


def _counter(df: DataFrame, size: int, per_second: bool) -> DataFrame:
    """Increase over the samples in the range, in which a fall is a reset to zero; the step into the range's first sample does not count."""
    window = _window().rangeBetween(-(size - 1), 0)
    step = F.when(F.col("value") < F.col("_v0"), F.col("value")).otherwise(F.col("value") - F.col("_v0"))
    rows = in_blocks(df, size).withColumn("_v0", F.lag("value").over(W.partitionBy(_SERIES, _BLOCK).orderBy(_US, "value"))).withColumn("_step", F.coalesce(step, F.lit(0.0)))
    start = F.min(F.struct(F.col(_US).alias("us"), F.col("value").alias("v"), F.col("_step").alias("step"))).over(window)
    rows = rows.withColumns({"_all": F.sum("_step").over(window), "_start": start, "_n": F.count(F.lit(1)).over(window)}).where(_OWN)
    total, seconds = F.col("_all") - F.col("_start.step"), (F.col(_US) - F.col("_start.us")) / 1e6
    out = F.when(seconds > 0, total / F.when(seconds > 0, seconds)) if per_second else total
    return rows.where("_n > 1").select("labels", "ts", out.alias("value")).where("value is not null")


def delta(df: DataFrame, size: int) -> DataFrame:
    """The last value of the range less its first."""
    first = F.min(_at()).over(_window().rangeBetween(-(size - 1), 0))
    return in_blocks(df, size).withColumn("_out", F.col("value") - first["v"]).where(_OWN).select("labels", "ts", F.col("_out").alias("value"))


def last_over_time(df: DataFrame, size: int) -> DataFrame:
    """The range's last value, the greatest of those at one time."""
    last = F.max(_at()).over(_window().rangeBetween(-(size - 1), 0))
    return in_blocks(df, size).withColumn("_out", last["v"]).where(_OWN).select("labels", "ts", F.col("_out").alias("value"))


#: Functions of the compatible language.
COMPATIBLE = {"rate": rate, "increase": increase}
#: Further functions of the extended mode. ``reset_rate`` and ``reset_increase`` know counter resets inside the range.
EXTENDED = {
    "irate": _pair(lambda a, b, s: F.when(b < a, b).otherwise(b - a) / s),
    "idelta": _pair(lambda a, b, s: b - a),
    "reset_rate": lambda df, size: _counter(df, size, True),
    "reset_increase": lambda df, size: _counter(df, size, False),
    "delta": delta,
    "sum_over_time": _over(F.sum),
    "avg_over_time": _over(F.avg),
    "min_over_time": _over(F.min),
    "max_over_time": _over(F.max),
    "count_over_time": _over(F.count),
    "last_over_time": last_over_time,
    "stddev_over_time": _over(F.stddev_pop),
    "stdvar_over_time": _over(F.var_pop),
}
