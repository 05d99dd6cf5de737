"""Rollups from raw to 5 minutes to 1 hour, and what is kept of each."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.scalars import average, floor_to
from tidemark.model import FIVE_MINUTES, ONE_HOUR, RAW

#: Buckets in minutes.
MINUTES = {FIVE_MINUTES: 5, ONE_HOUR: 60}
#: Raw samples are rolled up between these ages and then deleted; so are 5-minute ones. Hourly ones stay.
RAW_LOOKBACK, RAW_AGE = timedelta(hours=12), timedelta(hours=6)
FIVE_LOOKBACK, FIVE_AGE = timedelta(days=7), timedelta(days=2)
#: Seconds before a run that failed is tried again.
PAUSES = (30.0, 60.0, 120.0)
#: Labels by which a rollup is written where only labels can be stored.
INTERNAL = ("__resolution__", "__sum__", "__count__", "__min__", "__max__")


def _rolled(rows: DataFrame, resolution: str, key, total, count, low, high) -> DataFrame:
    grouped = rows.groupBy("name", key.alias("_key"), floor_to(F.col("ts"), MINUTES[resolution]).alias("ts")).agg(total.alias("sum"), count.alias("count"), low.alias("min"), high.alias("max"))
    return grouped.select(
        "name",
        F.lit("gauge").alias("type"),
        average(F.col("sum"), F.col("count")).alias("value"),
        F.map_from_entries("_key").alias("labels"),
        "ts",
        F.lit(resolution).alias("resolution"),
        F.struct("sum", "count", "min", "max").alias("agg"),
    )


def _window(rows: DataFrame, start, end) -> DataFrame:
    if start is None and end is None:
        return rows
    if not start < end:
        raise ValueError("start is before end")
    return rows.where(model.in_range(start, end))


def five_minutes(samples: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Sum, count, least and greatest raw value of each series and 5-minute bucket; the row's value is the mean, its type a gauge."""
    raw = _window(samples.where(F.col("resolution") == RAW), start, end)
    return _rolled(raw, FIVE_MINUTES, model.series_key(model.series_labels()), F.sum("value"), F.count(F.lit(1)), F.min("value"), F.max("value"))


def one_hour(samples: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The 5-minute rows of each hour together; internal labels are dropped."""
    rows = _window(samples.where((F.col("resolution") == FIVE_MINUTES) & F.col("agg").isNotNull()), start, end)
    return _rolled(rows, ONE_HOUR, model.series_key(model.user_labels()), F.sum("agg.sum"), F.sum("agg.count"), F.min("agg.min"), F.max("agg.max"))


def with_internal_labels(rolled: DataFrame) -> DataFrame:
    """Rollups as plain samples, whose aggregate is written in internal labels with six decimals."""
    def decimals(c: str):
        return F.format_string("%.6f", F.col(f"agg.{c}"))
    extra = F.create_map(F.lit("__resolution__"), F.col("resolution"), F.lit("__sum__"), decimals("sum"), F.lit("__count__"), F.col("agg.count").cast("string"), F.lit("__min__"), decimals("min"), F.lit("__max__"), decimals("max"))
    plain = F.map_filter(F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(list(INTERNAL)))
    return rolled.withColumn("labels", F.when(F.col("agg").isNotNull(), F.map_concat(plain, extra)).otherwise(F.col("labels")))


def from_internal_labels(samples: DataFrame) -> DataFrame:
    """Samples whose internal labels are an aggregate, as rollups; ``agg`` is null where one is missing or malformed."""
    def number(key: str, kind: str):
        return model.label(key).try_cast(kind)
    parts = [number("__sum__", "double").alias("sum"), number("__count__", "bigint").alias("count"), number("__min__", "double").alias("min"), number("__max__", "double").alias("max")]
    whole = F.struct(*parts)
    good = model.label("__resolution__").isin(FIVE_MINUTES, ONE_HOUR)
    for key, kind in (("__sum__", "double"), ("__count__", "bigint"), ("__min__", "double"), ("__max__", "double")):
        good = good & number(key, kind).isNotNull()
    good = F.coalesce(good, F.lit(False))
    return samples.withColumns(
        {
            "agg": F.when(good, whole),
            "resolution": F.coalesce(model.label("__resolution__"), F.lit(RAW)),
            "labels": F.map_filter("labels", lambda k, v: ~k.isin(list(INTERNAL))),
        }
    )


def plan(now: datetime) -> dict[str, tuple[datetime, datetime]]:
    """The windows that a run at ``now`` rolls up, widened to whole buckets so that a second run gives the same rows."""
    def whole(at: datetime, minutes: int) -> datetime:
        size = timedelta(minutes=minutes)
        return at - (at - datetime(1970, 1, 1, tzinfo=at.tzinfo)) % size
    tick = timedelta(microseconds=1)
    return {
        FIVE_MINUTES: (whole(now - RAW_LOOKBACK, 5), whole(now - RAW_AGE, 5) - tick),
        ONE_HOUR: (whole(now - FIVE_LOOKBACK, 60), whole(now - FIVE_AGE, 60) - tick),
    }


def kept(samples: DataFrame, before: datetime, resolution: str | None = None) -> DataFrame:
    """What stays when samples before a time are deleted, of one resolution or of all."""
    gone = F.col("ts") < F.lit(before).cast("timestamp")
    if resolution is not None:
        gone = gone & (F.col("resolution") == resolution)
    return samples.where(~F.coalesce(gone, F.lit(False)))


def compact_store(store, now: datetime) -> dict[str, int]:
    """One run over an upsert store: raw samples are rolled up and the old ones deleted, then 5-minute ones to hourly ones. Returns what was written and deleted.

    Rollups are written before anything is deleted, and replace those of an earlier run that broke off, so a run can be repeated.
    """
    if not store.upsert:
        raise ValueError("a store that keeps every row would hold rollups twice")
    windows, done = plan(now), {}
    for resolution, roll, old, age in ((FIVE_MINUTES, five_minutes, RAW, RAW_AGE), (ONE_HOUR, one_hour, FIVE_MINUTES, FIVE_LOOKBACK)):
        start, end = windows[resolution]
        rolled = roll(store.query(start, end), start, end)
        store.write(rolled)
        done[resolution] = store.query(start, end).where(F.col("resolution") == resolution).count()
        done[f"deleted {old or 'raw'}"] = store.delete(now - age, old)
    return done


def maintained(store, now: datetime, pauses: tuple[float, ...] = PAUSES, sleep=time.sleep) -> dict:
    """:func:`compact_store`, tried again after each of ``pauses``; what it did, how often it was tried, the last error, and whether it ended well."""
    for attempt, pause in enumerate((*pauses, None), 1):
        try:
            return {"healthy": True, "attempts": attempt, "error": None, **compact_store(store, now)}
        except Exception as e:  # any failure of a job is tried again, and told if it stays
            if pause is None:
                return {"healthy": False, "attempts": attempt, "error": str(e)}
            sleep(pause)
    raise AssertionError


def compacted(samples: DataFrame, now: datetime) -> DataFrame:
    """All samples after one run at ``now``: rolled up, replaced where a bucket was there before, and the old ones deleted."""
    windows = plan(now)
    rolled = five_minutes(samples, *windows[FIVE_MINUTES])
    left = kept(samples, now - RAW_AGE, RAW)
    there = ["name", "_key", "resolution", "ts"]

    def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
        a, b = (x.withColumn("_key", model.series_key()) for x in (old, new))
        return a.join(b.select(*there), there, "left_anti").drop("_key").unionByName(new)

    left = replaced(left, rolled)
    hourly = one_hour(left, *windows[ONE_HOUR])
    return replaced(kept(left, now - FIVE_LOOKBACK, FIVE_MINUTES), hourly)
