"""What charts ask for: downsampled ranges, latest points, names."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import running
from tidemark.sources.store import matching

#: Points of a chart by default and at most, and its longest range.
POINTS, MAX_POINTS, MAX_RANGE = 1000, 5000, timedelta(days=90)
#: Rows that the list of names looks at.
NAME_ROWS = 10_000


def downsampled(rows: DataFrame, keys: list[str], points: int) -> DataFrame:
    """Series of more than ``points`` points in consecutive chunks of n div ``points``: the first time and the mean value of each.

    A long series is put in places by pieces of time, so no task holds it whole.
    """
    placed = running.placed(rows, keys, ["ts", "value"]).withColumn("_i", F.col("_i") - 1)
    size = F.greatest(F.lit(1).cast("bigint"), F.when(F.col("_n") > points, F.expr(f"_n div {points}")).otherwise(1))
    chunk = placed.withColumn("_size", size).withColumn("_chunk", F.expr("_i div _size"))
    return chunk.groupBy(*keys, "_chunk").agg(F.min("ts").alias("ts"), F.avg("value").alias("value")).drop("_chunk")


def range_points(samples: DataFrame, metric: str, start: datetime, end: datetime, points: int = POINTS, labels: dict[str, str] | None = None, resolution: str = model.RAW) -> DataFrame:
    """The chart of a metric in long form: ``labels`` (without internal ones), ``ts``, ``value``.

    ``resolution`` chooses what is read; ``all`` merges raw samples and rollups of a series into one line.
    """
    if not metric or len(metric.encode()) > model.MAX_NAME:
        raise ValueError("a metric's name of 1 to 256 bytes is needed")
    if end < start:
        raise ValueError("the end is not before the start")
    if end - start > MAX_RANGE:
        raise ValueError(f"a range of at most {MAX_RANGE.days} days")
    if not 1 <= points <= MAX_POINTS:
        raise ValueError(f"1 to {MAX_POINTS} points")
    rows = matching(samples, start, end, [metric], labels)
    if resolution != "all":
        rows = rows.where(F.col("resolution") == resolution)
    keyed = rows.select(model.series_key(model.user_labels()).alias("_key"), "ts", "value")
    return downsampled(keyed, ["_key"], points).select(F.map_from_entries("_key").alias("labels"), "ts", "value")


def as_series(points: DataFrame, metric: str, resolution: str = "raw") -> DataFrame:
    """A row for each series: metric, labels, points as (t in milliseconds, v) in order, and the resolution. For charts: at most about two times MAX_POINTS points a series."""
    ms = F.expr("unix_micros(ts) div 1000").alias("t")
    grouped = points.withColumn("_key", model.series_key()).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct(ms, F.col("value").alias("v")))).alias("points"))
    return grouped.select(F.lit(metric).alias("metric"), F.map_from_entries("_key").alias("labels"), "points", F.lit(resolution).alias("resolution"))


def latest_points(rows: DataFrame) -> DataFrame:
    """The last point of each series, the greatest value of those at one time."""
    last = rows.withColumn("_key", model.series_key()).groupBy("_key").agg(F.max(F.struct("ts", "value")).alias("p"))
    return last.select(F.map_from_entries("_key").alias("labels"), "p.ts", "p.value")


def names(samples: DataFrame, start: datetime, end: datetime, rows: int | None = NAME_ROWS) -> DataFrame:
    """Names of raw samples in a range, in order. The first ``rows`` rows are looked at, in the store's order, before rollups are left out; all for None."""
    return matching(samples, start, end, limit=rows).where(F.col("resolution") == model.RAW).select("name").distinct().orderBy("name")


def latest_total(samples: DataFrame, at: datetime, lookback: timedelta = timedelta(minutes=5)) -> DataFrame:
    """Per name, the whole part of each series' latest value in the lookback, added up."""
    recent = matching(samples, at - lookback, at).withColumn("_key", model.series_key())
    last = recent.groupBy("name", "_key").agg(F.max(F.struct("ts", "value")).alias("p"))
    return last.groupBy("name").agg(F.sum(F.col("p.value").cast("bigint")).alias("total"))
