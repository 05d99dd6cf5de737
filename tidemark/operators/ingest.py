"""What comes in: validation, defaults, cardinality."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import model

#: Samples of a request; series in all and of one name.
MAX_REQUEST, MAX_SERIES, MAX_SERIES_OF_NAME = 1000, 100_000, 10_000
#: Ages that an imported sample may have.
IMPORT_PAST, IMPORT_FUTURE = timedelta(days=3650), timedelta(hours=24)

#: Age at which a series no longer counts.
EXPIRY = timedelta(hours=24)

_SAMPLE = "struct<name:string,type:string,value:double,labels:map<string,string>,timestamp:string>"


class Rejected(ValueError):
    """A request that is refused as a whole; ``status`` is the HTTP status of the reason."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def from_json(bodies: DataFrame, body: str = "value") -> DataFrame:
    """Samples of ingest bodies ``{"metrics": [...]}``, with ``index``, their place in the body, and ``body_id`` if there is one."""
    parsed = bodies.withColumn("_m", F.from_json(body, f"struct<metrics:array<{_SAMPLE}>>")["metrics"])
    keep = [c for c in bodies.columns if c != body]
    return parsed.select(*keep, F.posexplode("_m").alias("index", "m")).select(*keep, "index", "m.name", "m.type", "m.value", "m.labels", F.col("m.timestamp").try_cast("timestamp").alias("ts"))


def with_default_time(samples: DataFrame, now: datetime | None = None) -> DataFrame:
    """Samples without a time get the time of arrival."""
    return samples.withColumn("ts", F.coalesce("ts", F.current_timestamp() if now is None else F.lit(now).cast("timestamp")))


def error(name: str = "name", labels: str = "labels") -> Column:
    """Why a sample is invalid, null if it is valid. Lengths are in bytes; the first rule that fails is told."""
    keys, values = F.map_keys(labels), F.map_values(labels)
    return (
        F.when(F.col(name).isNull() | (F.col(name) == ""), "metric name cannot be empty")
        .when(F.octet_length(name) > model.MAX_NAME, "metric name too long")
        .when(F.size(F.coalesce(keys, F.array().cast("array<string>"))) > model.MAX_LABELS, "too many labels")
        .when(F.exists(keys, lambda k: F.octet_length(k) > model.MAX_KEY), "label key too long")
        .when(F.exists(values, lambda v: F.octet_length(v) > model.MAX_VALUE), "label value too long")
    )


def import_error(now: Column | datetime) -> Column:
    """Why an imported sample is refused, null if it isn't."""
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return (
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", "metric name cannot be empty")
        .when(~F.coalesce(F.col("type"), F.lit("")).isin(*model.KINDS), F.concat(F.lit('invalid metric type: "'), F.coalesce(F.col("type"), F.lit("")), F.lit('"')))
        .when(F.col("ts").isNull(), "metric timestamp cannot be zero")
        .when(F.col("ts") < at - F.expr(f"INTERVAL {IMPORT_PAST.days} DAYS"), "timestamp too far in past")
        .when(F.col("ts") > at + F.expr("INTERVAL 24 HOURS"), "timestamp too far in future")
    )


def cardinality_key() -> Column:
    """A series for the cardinality limits: internal labels don't count."""
    return model.series_key(model.user_labels())


def new_series(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Series (``name``, ``series``) of a batch that are not known yet."""
    own = batch.select("name", cardinality_key().alias("series")).distinct()
    return own.join(known.select("name", "series"), ["name", "series"], "left_anti")


def cardinality_errors(batch: DataFrame, known: DataFrame, limit: int = MAX_SERIES, limit_of_name: int = MAX_SERIES_OF_NAME) -> DataFrame:
    """New series that are over a limit, with ``error``. All are judged by what was known before the batch."""
    fresh = new_series(batch, known)
    total = known.count()
    counts = known.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    judged = fresh.join(counts, "name", "left").withColumn(
        "error", F.when(F.lit(total) >= limit, "cardinality limit exceeded").when(F.coalesce("_n", F.lit(0)) >= limit_of_name, "metric cardinality limit exceeded")
    )
    return judged.where("error is not null").select("name", "series", "error")


def cardinality(samples: DataFrame) -> DataFrame:
    """One row: series in all, names, the name of most series and their number, and use of the limit in percent."""
    series = samples.select("name", cardinality_key().alias("series")).distinct()
    by_name = series.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    top = F.max_by("name", F.struct(F.col("n"), F.col("name")))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return by_name.agg(total.alias("total_series"), F.count(F.lit(1)).alias("unique_metrics"), top.alias("largest_metric"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_count"), (total * 100.0 / MAX_SERIES).alias("utilization"))


def series_seen(samples: DataFrame) -> DataFrame:
    """When each series was last seen."""
    return samples.groupBy("name", cardinality_key().alias("series")).agg(F.max("ts").alias("last_seen"))


def expired(seen: DataFrame, now: datetime, age: timedelta = EXPIRY) -> DataFrame:
    """Series not seen for longer than ``age``."""
    return seen.where(F.col("last_seen") < F.lit(now - age).cast("timestamp"))


def accepted(batch: DataFrame, known: DataFrame, now: datetime | None = None, storage_full: bool = False) -> DataFrame:
    """A request's samples, checked in order: its size, the storage quota, each sample, cardinality. One bad sample refuses all.

    A request is bounded by its size limit, so its checks are small jobs.
    """
    n = batch.limit(MAX_REQUEST + 1).count()
    if n > MAX_REQUEST:
        raise Rejected(400, f"too many metrics: at most {MAX_REQUEST}")
    if storage_full:
        raise Rejected(507, "storage limit exceeded")
    rows = with_default_time(batch, now)
    order = "index" if "index" in rows.columns else F.monotonically_increasing_id()
    bad = rows.withColumn("error", error()).where("error is not null").orderBy(order).select("error").first()
    if bad:
        raise Rejected(400, bad[0])
    over = cardinality_errors(rows, known).orderBy("name").first()
    if over:
        raise Rejected(429, over["error"])
    return model.samples(rows)


def first_error(samples: DataFrame, request: str, index: str = "index") -> DataFrame:
    """For many requests at once: the first failing sample of each, by ``request``; requests without one are not listed."""
    bad = samples.withColumn("error", error()).where("error is not null")
    return bad.groupBy(request).agg(F.min_by(F.struct(F.col(index).alias("index"), "error"), index).alias("e")).select(request, "e.index", "e.error")


class Quota:
    """A store's size against a limit, looked up again after ten seconds."""

    def __init__(self, size, limit: int, clock, keep: float = 10.0):
        self._size, self._limit, self._clock, self._keep, self._held = size, limit, clock, keep, None

    def exceeded(self) -> bool:
        if self._held is None or self._clock() - self._held[0] >= self._keep:
            self._held = (self._clock(), self._size())
        return self._held[1] >= self._limit
