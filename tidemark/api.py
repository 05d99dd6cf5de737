"""The query interfaces as Python calls: the same checks, defaults and response shapes, without a server."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.scalars import six_decimals
from tidemark.operators import chart, ingest
from tidemark.plans.lower import Planner
from tidemark.sources import exchange
from tidemark.sources.store import SampleStore, matching

#: Range and step of a query that gives none, and how far an instant query looks back.
QUERY_RANGE, STEP, LOOKBACK = timedelta(hours=1), timedelta(seconds=15), timedelta(minutes=5)

_STEP = re.compile(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)")
_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


class BadRequest(ValueError):
    """A call that the interface refuses."""


def go_duration(text: str) -> timedelta:
    """A duration such as ``15s`` or ``1m30s``."""
    parts = _STEP.findall(text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise BadRequest(f"invalid duration: {text!r}")
    return timedelta(seconds=sum(float(a) * _SECONDS[b] for a, b in parts))


def moment(text: str | None, default: datetime, unix: bool = False) -> datetime:
    """A time as RFC 3339, or without a zone, or (``unix``) as seconds; what can't be read is the default."""
    if not text:
        return default
    if unix:
        try:
            return datetime.fromtimestamp(float(text), timezone.utc)
        except ValueError:
            pass
    try:
        found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return default
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


class QueryApi:
    """Queries over a DataFrame of samples. ``clock`` gives the time.

    A query reads all samples, as no process holds them together; ``max_samples``, if given, refuses those that would read more.
    """

    def __init__(self, samples: DataFrame, clock=lambda: datetime.now(timezone.utc), mode: str = "compat", resolution: str = model.RAW, max_samples: int | None = None):
        self.samples, self.clock, self.mode, self.resolution, self.max_samples = samples, clock, mode, resolution, max_samples

    def _planner(self, start: datetime, end: datetime, step: timedelta) -> Planner:
        return Planner(self.samples, start, end, step, self.mode, self.resolution, self.max_samples)

    def execute(self, query: str, start: datetime | None = None, end: datetime | None = None, step: str | timedelta | None = None) -> DataFrame:
        """A range query: a row a series with ``metric`` and ``values``, of (whole second, value as text with six decimals)."""
        if not query:
            raise BadRequest("a query is needed")
        now = self.clock()
        end = end or now
        start = start or end - QUERY_RANGE
        if not start < end:
            raise BadRequest("start is before end")
        step = go_duration(step) if isinstance(step, str) else step or STEP
        return self._matrix(self._planner(start, end, step).query(query))

    @staticmethod
    def _matrix(points: DataFrame) -> DataFrame:
        at = F.expr("unix_micros(ts) div 1000000")
        grouped = points.withColumn("_key", model.series_key()).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("ts", at.alias("t"), six_decimals(F.col("value")).alias("v")))).alias("_p"))
        return grouped.select(F.map_from_entries("_key").alias("metric"), F.transform("_p", lambda p: F.struct(p["t"].alias("t"), p["v"].alias("v"))).alias("values"))

    def instant(self, query: str, at: datetime | None = None) -> DataFrame:
        """The last point of each series in the five minutes up to a time."""
        if not query:
            raise BadRequest("a query is needed")
        at = at or self.clock()
        return self._matrix(chart.latest_points(self._planner(at - LOOKBACK, at, timedelta(seconds=1)).query(query)))

    def query(self, query: str, time: str | None = None) -> DataFrame:
        """The Prometheus-style instant query."""
        return self.instant(query, moment(time, self.clock()))

    def query_range(self, query: str, start: str | None = None, end: str | None = None, step: str | None = None) -> DataFrame:
        """The Prometheus-style range query: times in Unix seconds or RFC 3339, a step in seconds or as a duration."""
        now = self.clock()
        last = moment(end, now, True)
        try:
            by = timedelta(seconds=float(step)) if step else STEP
        except ValueError:
            by = go_duration(step)
        return self.execute(query, moment(start, last - QUERY_RANGE, True), last, by)

    def total_points(self, query: str, start: datetime, end: datetime) -> int:
        """How many points a range query gives."""
        return self._planner(start, end, STEP).query(query).count()

    def chart(self, metric: str, start: datetime, end: datetime, points: int = chart.POINTS, labels: dict[str, str] | None = None) -> DataFrame:
        """A chart's series, downsampled."""
        name = {model.RAW: "raw"}.get(self.resolution, self.resolution)
        return chart.as_series(chart.range_points(self.samples, metric, start, end, points, labels, self.resolution), metric, name)

    def raw(self, metric: str | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Samples as stored, of the last hour by default."""
        end = end or self.clock()
        start = start or end - QUERY_RANGE
        if not start < end:
            raise BadRequest("start is before end")
        return matching(self.samples, start, end, [metric] if metric else None)

    def names(self) -> DataFrame:
        """Names of the last day."""
        now = self.clock()
        return chart.names(self.samples, now - timedelta(hours=24), now)


class StoreApi:
    """Ingest, export, import and statistics over a store."""

    def __init__(self, store: SampleStore, clock=lambda: datetime.now(timezone.utc), quota: ingest.Quota | None = None):
        self.store, self.clock, self.quota = store, clock, quota

    def ingest(self, body: str) -> int:
        """Checks a body and writes its samples; one that can't be taken raises ``ingest.Rejected``. Returns how many were written."""
        rows = ingest.from_json(self.store.spark.createDataFrame([(body,)], "value string"))
        now = self.clock()
        known = self.store.series(now - ingest.EXPIRY)
        good = ingest.accepted(rows, known, now, bool(self.quota and self.quota.exceeded()))
        n = good.count()
        if n:
            self.store.write(good)
            self.store.record(good.select("name", ingest.cardinality_key().alias("series")).distinct(), now)
        return n

    def expire(self) -> int:
        """Forgets series that were not seen for a day; to be run each hour."""
        return self.store.forget(self.clock() - ingest.EXPIRY)

    def export(self, path: str, kind: str = "json", start: datetime | None = None, end: datetime | None = None, metric: str | None = None):
        """Writes an export of the last day by default, of 30 days at most."""
        if kind not in ("json", "csv"):
            raise BadRequest("the format is json or csv")
        end = end or self.clock()
        start = start or end - exchange.DEFAULT_RANGE
        if not start < end or end - start > exchange.MAX_RANGE:
            raise BadRequest(f"start is before end, by at most {exchange.MAX_RANGE.days} days")
        names = [metric] if metric else None
        if kind == "csv":
            return exchange.export_csv(self.store.samples(start, end), path, start, end, names)
        return exchange.export_json(self.store.samples(start, end, apart=True), path, start, end, self.clock(), names)

    def import_(self, path: str, content_type: str = "application/json", lines: bool = False) -> dict:
        if content_type != "application/json":
            raise BadRequest("the content type is application/json")
        return exchange.import_json(self.store, path, self.clock(), lines)

    def statistics(self) -> DataFrame:
        return self.store.statistics()

    def cardinality(self) -> DataFrame:
        return ingest.cardinality(self.store.samples())
