"""What a dashboard shows of metrics: services, status, trend, summaries, comparison."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import running

#: Warning and critical levels by a part of the metric's name; the first part that fits counts.
THRESHOLDS = {
    "error_rate": (0.01, 0.05),
    "latency": (100, 500),
    "response_time": (200, 1000),
    "cpu_usage": (70, 90),
    "memory_usage": (75, 90),
    "disk_usage": (80, 95),
    "request_duration": (1000, 5000),
    "failure_rate": (0.02, 0.1),
}
#: Names of system metrics begin with these.
SYSTEM = ("go_", "process_", "runtime_")
#: Relative changes of a trend that is stable, and beyond which it rises or falls.
STABLE, MOVING = 0.05, 0.2


def service() -> Column:
    """A series' service: its label, else the internal one, else ``default``."""
    return F.coalesce(F.nullif(model.label("service"), F.lit("")), F.nullif(model.label("__service"), F.lit("")), F.lit("default"))


def services(samples: DataFrame) -> DataFrame:
    """The endpoints of each service, from the labels ``endpoint`` and ``path``."""
    both = F.array_compact(F.array(model.label("endpoint"), model.label("path")))
    ends = samples.select(service().alias("service"), F.explode_outer(both).alias("endpoint")).distinct()
    return ends.groupBy("service").agg(F.sort_array(F.collect_list("endpoint")).alias("endpoints"))


def is_system(name: str = "name") -> Column:
    return F.col(name).rlike(f"^({'|'.join(SYSTEM)})")


def kind(name: str = "name") -> Column:
    """A metric's type, guessed from its name."""
    n = F.col(name)
    return F.when(n.contains("_total") | n.contains("_count"), "counter").when(n.contains("_bucket") | n.contains("_duration"), "histogram").otherwise("gauge")


def browse(samples: DataFrame, search: str = "", only_kind: str = "all", only_service: str = "all", system: bool = True, endpoint: str | None = None) -> DataFrame:
    """Samples whose name holds ``search`` in any case, of a guessed type, a service and an endpoint."""
    rows = samples.where(F.lower("name").contains(search.lower()))
    if only_kind != "all":
        rows = rows.where(kind() == only_kind)
    if only_service != "all":
        rows = rows.where(service() == only_service)
    if endpoint is not None:
        rows = rows.where(F.coalesce(model.label("endpoint") == endpoint, F.lit(False)) | F.coalesce(model.label("path") == endpoint, F.lit(False)))
    return rows if system else rows.where(~is_system())


def summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, latest value and number of points of each group."""
    return samples.groupBy(*keys).agg(F.avg("value").alias("avg"), F.max(F.struct("ts", "value"))["value"].alias("latest"), F.count(F.lit(1)).alias("points"))


def statistics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Least, greatest and mean value, series and points of each group."""
    return samples.groupBy(*keys).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.count_distinct(model.series_key()).alias("series"), F.count(F.lit(1)).alias("points"))


def trend(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The second half's mean over the first half's, less one; 0 with fewer than two points or a first mean of 0.

    The point in the middle of an odd number belongs to the second half.
    """
    placed = running.placed(points, keys, order)
    early = F.col("_i") <= F.expr("_n div 2")
    halves = placed.groupBy(*keys).agg(F.avg(F.when(early, F.col("value"))).alias("_a"), F.avg(F.when(~early, F.col("value"))).alias("_b"))
    safe = F.when(F.col("_a") != 0, F.col("_a"))
    return halves.select(*keys, F.coalesce((F.col("_b") - F.col("_a")) / safe, F.lit(0.0)).alias("trend"))


def status(name: Column, average: Column, latest: Column, change: Column) -> Column:
    """A metric's state by the level of its latest value, or by its trend if its name has no level."""
    value = F.coalesce(latest, average)
    out = None
    for part, (warning, critical) in THRESHOLDS.items():
        level = F.when(value >= critical, "Critical").when(value >= warning, "Warning").otherwise("Healthy")
        found = F.lower(name).contains(part)
        out = F.when(found, level) if out is None else out.when(found, level)
    return out.otherwise(F.when(F.abs(change) < STABLE, "Stable").when(change > MOVING, "Rising").when(change < -MOVING, "Declining").otherwise("Stable"))


def compared(points: DataFrame, keys: list[str], shift: timedelta = timedelta(hours=24)) -> DataFrame:
    """Each point beside the one of its series that is exactly ``shift`` older, null where there is none."""
    micros = shift // timedelta(microseconds=1)
    past = points.select(*keys, F.timestamp_micros(F.unix_micros("ts") + F.lit(micros)).alias("ts"), F.col("value").alias("before"))
    return points.join(past, [*keys, "ts"], "left")


def overlaid(points: DataFrame, shift: timedelta = timedelta(hours=24)) -> DataFrame:
    """The points and the same points ``shift`` later, told apart by ``line``."""
    micros = shift // timedelta(microseconds=1)
    later = points.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.lit(micros)))
    return points.withColumn("line", F.lit("now")).unionByName(later.withColumn("line", F.lit("before")))


def long_csv(points: DataFrame) -> DataFrame:
    """Rows ``Timestamp,Series,Value``; a series is its labels as ``key=value`` in order."""
    series = F.array_join(F.transform(model.series_key(), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return points.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("Timestamp"), series.alias("Series"), F.col("value").alias("Value"))
