"""Ingest, rollup and live feed as streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import model
from tidemark.functions.scalars import average
from tidemark.operators import ingest
from tidemark.sources.store import SampleStore, matching

#: How late a sample may be; how often and over how long the live feed looks, and its rows at most.
LATE, EVERY, LIVE, LIVE_ROWS = "6 hours", "5 seconds", timedelta(minutes=1), 1000


def bodies(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of ingest bodies, one a line, from files that arrive in a folder."""
    reader = spark.readStream
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.text(path)


def valid_samples(stream: DataFrame, now=None) -> DataFrame:
    """The valid samples of the bodies. A body is refused as a whole if a sample in it is invalid or there are too many."""
    metrics = F.from_json("value", "struct<metrics:array<struct<name:string,type:string,value:double,labels:map<string,string>,timestamp:string>>>")["metrics"]
    rows = stream.select(metrics.alias("m")).where(F.size("m") <= ingest.MAX_REQUEST)

    def bad(m):
        keys, values = F.map_keys(m["labels"]), F.map_values(m["labels"])
        no_keys = F.array().cast("array<string>")
        return (
            F.coalesce(m["name"], F.lit("")).eqNullSafe("")
            | (F.octet_length(m["name"]) > model.MAX_NAME)
            | (F.size(F.coalesce(keys, no_keys)) > model.MAX_LABELS)
            | F.exists(F.coalesce(keys, no_keys), lambda k: F.octet_length(k) > model.MAX_KEY)
            | F.exists(F.coalesce(values, no_keys), lambda v: F.coalesce(F.octet_length(v), F.lit(0)) > model.MAX_VALUE)
        )

    flat = rows.where(~F.exists("m", bad)).select(F.explode("m").alias("m")).select("m.name", "m.type", "m.value", "m.labels", F.col("m.timestamp").try_cast("timestamp").alias("ts"))
    return model.samples(ingest.with_default_time(flat, now))


def rolled_up(samples: DataFrame, late: str = LATE, deduplicate: bool = True) -> DataFrame:
    """5-minute rollups of a stream; in append mode a bucket comes out once it can't change. Repeated samples count once; those that differ in ``model.SAMPLE`` are no repeats."""
    rows = samples.withWatermark("ts", late).withColumn("_key", model.series_key())
    if deduplicate:
        rows = rows.dropDuplicatesWithinWatermark(["name", "_key", "ts"])
    grouped = rows.withColumn("_key", model.series_key(model.series_labels())).groupBy("name", "_key", F.window("ts", "5 minutes").alias("w")).agg(F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))
    return grouped.select(
        "name",
        F.lit("gauge").alias("type"),
        average(F.col("sum"), F.col("count")).alias("value"),
        F.map_from_entries("_key").alias("labels"),
        F.col("w.start").alias("ts"),
        F.lit(model.FIVE_MINUTES).alias("resolution"),
        F.struct("sum", "count", "min", "max").alias("agg"),
    )


def into_store(samples: DataFrame, store: SampleStore, checkpoint: str, available_now: bool = True):
    """Writes a stream into a store. A batch's number orders its rows, so a batch that is written twice leaves one row of each."""
    writer = samples.writeStream.foreachBatch(lambda batch, n: store.write(batch, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=EVERY)).start()


def into_store_and_late(samples: DataFrame, store: SampleStore, late: str, checkpoint: str, clock, delay: timedelta = timedelta(hours=6), available_now: bool = True):
    """:func:`into_store`, but samples that are older than ``delay`` when they come, whose rollup may be done, go to Parquet files in ``late``, by batch."""

    def write(batch: DataFrame, n: int) -> None:
        bound = F.lit(clock() - delay).cast("timestamp")
        store.write(batch.where(F.col("ts") >= bound), n)
        batch.where(F.col("ts") < bound).write.mode("overwrite").parquet(f"{late}/batch={n}")

    writer = samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=EVERY)).start()


def live_feed(spark: SparkSession, store: SampleStore, send: Callable[[list], None], listening: Callable[[], bool], checkpoint: str, clock):
    """Every five seconds, if anyone listens, sends the last minute's samples, so many at most."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_: DataFrame, __: int) -> None:
        if listening():
            now = clock()
            send(matching(store.samples(now - LIVE, now), now - LIVE, now, limit=LIVE_ROWS).collect())

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=EVERY).start()


def first_seen_series(samples: DataFrame, expiry: timedelta = timedelta(hours=24)) -> DataFrame:
    """Series as they are first seen, and again after they were not seen for ``expiry``: the cardinality tracker's state, kept for each series."""
    age = int(expiry.total_seconds() * 1000)
    rows = samples.withWatermark("ts", LATE).select("name", F.to_json(F.map_from_entries(ingest.cardinality_key())).alias("series"), "ts")

    def track(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = max(frame["ts"].max() for frame in frames)
        fresh = not state.exists
        at = max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs())
        state.update((at,))
        state.setTimeoutTimestamp(at + age)
        if fresh:
            yield pd.DataFrame({"name": [key[0]], "series": [key[1]], "seen": [last]})

    return rows.groupBy("name", "series").applyInPandasWithState(track, "name string, series string, seen timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
