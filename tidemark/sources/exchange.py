"""Export to JSON and CSV, import from JSON."""

from __future__ import annotations

from datetime import datetime, timedelta
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.scalars import shortest
from tidemark.operators.ingest import import_error
from tidemark.sources.store import in_order, matching

#: Version of the JSON format, rows of an import batch, and ranges of an export.
VERSION, BATCH = "1.0", 5000
DEFAULT_RANGE, MAX_RANGE = timedelta(hours=24), timedelta(days=30)
#: Label keys that a CSV export has columns for, and metrics of a single JSON document, at most.
MAX_KEYS, MAX_DOCUMENT = 10_000, 1_000_000

_METRIC = "struct<name:string,type:string,value:double,labels:map<string,string>,timestamp:string>"


def utc_text(ts: Column) -> Column:
    """RFC 3339 in whole seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_fine(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def label_keys(samples: DataFrame) -> DataFrame:
    """The different label keys, in order, as ``key``."""
    return samples.select(F.explode(F.map_keys("labels")).alias("key")).distinct().orderBy("key")


def csv_rows(samples: DataFrame, keys: list[str]) -> DataFrame:
    """``timestamp,name,type,value`` and a column for each of the label keys; a label that is missing is empty."""
    labels = [F.coalesce(model.label(k), F.lit("")).alias(k) for k in keys]
    return samples.select(utc_text(F.col("ts")).alias("timestamp"), "name", F.coalesce("type", F.lit("")).alias("type"), shortest(F.col("value")).alias("value"), *labels)


def export_csv(samples: DataFrame, path: str, start: datetime | None = None, end: datetime | None = None, names: list[str] | None = None) -> list[str]:
    """Writes a folder of CSV files with a header, in the store's order; returns the label keys. The keys, not the samples, go to the driver."""
    rows = matching(samples, start, end, names)
    keys = [r[0] for r in label_keys(rows).limit(MAX_KEYS + 1).toLocalIterator()]
    if len(keys) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} label keys, each of which would be a column")
    csv_rows(in_order(rows), keys).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)
    return keys


def json_rows(samples: DataFrame) -> DataFrame:
    """Each sample as the JSON of one metric."""
    metric = F.struct("name", "type", "value", F.when(F.size("labels") > 0, F.col("labels")).alias("labels"), utc_fine(F.col("ts")).alias("timestamp"))
    return samples.select(F.to_json(metric).alias("value"))


def json_document(samples: DataFrame, start: datetime, end: datetime, exported_at: datetime) -> DataFrame:
    """One row, ``document``: metadata and all metrics. For exports that one value can hold; larger ones go to :func:`export_json`."""
    metrics = in_order(samples).select(F.struct("name", "type", "value", "labels", utc_fine(F.col("ts")).alias("timestamp")).alias("m"))
    if samples.limit(MAX_DOCUMENT + 1).count() > MAX_DOCUMENT:
        raise ValueError(f"more than {MAX_DOCUMENT} metrics; export_json writes them as lines")
    whole = metrics.agg(F.collect_list("m").alias("metrics"), F.count(F.lit(1)).alias("n"))
    return whole.select(F.to_json(F.struct(_metadata(start, end, exported_at, F.col("n")).alias("metadata"), "metrics"), {"pretty": "true"}).alias("document"))


def _metadata(start: datetime, end: datetime, exported_at: datetime, count: Column) -> Column:
    texts = [utc_text(F.lit(t).cast("timestamp")).alias(n) for n, t in (("exported_at", exported_at), ("start_time", start), ("end_time", end))]
    return F.struct(*texts, count.alias("metric_count"), F.lit("json").alias("format"), F.lit(VERSION).alias("version"))


def export_json(samples: DataFrame, path: str, start: datetime, end: datetime, exported_at: datetime, names: list[str] | None = None) -> int:
    """Writes JSON lines in ``path``/metrics and the metadata in ``path``/metadata; returns the number of metrics."""
    rows = matching(samples, start, end, names)
    json_rows(in_order(rows)).write.mode("overwrite").text(f"{path}/metrics")
    written = rows.sparkSession.read.text(f"{path}/metrics").count()
    one = rows.sparkSession.range(1)
    one.select(F.to_json(_metadata(start, end, exported_at, F.lit(written).cast("bigint"))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return written


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of documents with metadata, one document a file, with ``index``, their place in it."""
    schema = f"struct<metadata:map<string,string>,metrics:array<{_METRIC}>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema)["metrics"].alias("m"))
    return _metric_columns(whole.select(F.posexplode("m").alias("index", "m")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of JSON lines, with ``index``: a number that rises through the files."""
    lines = spark.read.text(path).select(F.from_json("value", _METRIC).alias("m"), F.monotonically_increasing_id().alias("index"))
    return _metric_columns(lines)


def _metric_columns(rows: DataFrame) -> DataFrame:
    return rows.select("index", "m.name", "m.type", "m.value", "m.labels", F.col("m.timestamp").try_cast("timestamp").alias("ts"))


def checked_import(metrics: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The samples to import, and the refused ones as ``index`` and ``error``."""
    judged = metrics.withColumn("_why", import_error(now))
    good = model.samples(judged.where("_why is null"))
    bad = judged.where("_why is not null").select("index", F.concat(F.lit("metric "), F.col("index").cast("string"), F.lit(": "), F.col("_why")).alias("error"))
    return good, bad


def import_summary(metrics: DataFrame, now: datetime) -> DataFrame:
    """One row: metrics imported and refused, batches, and the first and last time of what is imported."""
    judged = metrics.withColumn("_why", import_error(now))
    good = F.col("_why").isNull()
    n = F.count(F.when(good, 1))
    return judged.agg(n.alias("imported"), F.count(F.when(~good, 1)).alias("errors"), F.ceil(n / BATCH).alias("batches"), F.min(F.when(good, F.col("ts"))).alias("start_time"), F.max(F.when(good, F.col("ts"))).alias("end_time"))


def import_json(store, path: str, now: datetime, lines: bool = False) -> dict:
    """Imports a file into a store; returns the summary with the first hundred errors."""
    metrics = (read_lines if lines else read_document)(store.spark, path)
    good, bad = checked_import(metrics, now)
    found = import_summary(metrics, now).first().asDict()
    if found["imported"]:
        store.write(good)
    return {**found, "batches": ceil(found["imported"] / BATCH), "messages": [r["error"] for r in bad.orderBy("index").limit(100).collect()]}
