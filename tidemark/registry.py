"""The engine's queries over the star-schema tables, and the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import ranges, scalars
from tidemark.operators import chart, ingest, insights, instruments, rollup
from tidemark.plans.lower import Planner
from tidemark.sources import exchange, store, tables

UTC = timezone.utc
#: The span of the events, and of the order and shipping days.
EVENTS = (datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC))
DAYS = (datetime(1990, 1, 1, tzinfo=UTC), datetime(2010, 1, 1, tzinfo=UTC))
#: Added before rounding to four places: means of a few values often lie half-way between two.
NUDGE = 0.0000017
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The sample views in SQL.
_EV = "ev AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, value, ts, event_id FROM events)"
_TOTAL = "tot AS (SELECT event_type, ts, CAST(count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value FROM events)"
_REV = "rev AS (SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, l_extendedprice * (1 - l_discount) AS value, l_shipdate AS ts FROM lineitem)"
_ORD = "ord AS (SELECT o_orderstatus AS orderstatus, o_orderpriority AS orderpriority, o_totalprice AS value, o_orderdate AS ts FROM orders)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace(", 4) AS value", f" + {NUDGE}, 4) AS value")
        return f

    return add


def evaluated(spark: SparkSession, folder: str, view: str, text: str, span=None, mode: str = "compat", step=timedelta(days=1)) -> DataFrame:
    """A query of the language over a view."""
    span = span or (EVENTS if view.startswith("event") else DAYS)
    return Planner(tables.VIEWS[view](spark, folder), *span, step=step, mode=mode).query(text)


def rounded(column: str = "value"):
    return F.round(F.col(column) + NUDGE, 4)


def flat(points: DataFrame, *labels: str) -> DataFrame:
    """Labels as columns, and the value rounded, as sums of doubles depend on their order."""
    return points.select(*(model.label(k).alias(k) for k in labels), "ts", rounded().alias("value"))


def language(name: str, view: str, text: str, labels: list[str], sql: str, **options) -> None:
    """Registers a query of the language."""

    def f(spark: SparkSession, folder: str) -> DataFrame:
        return flat(evaluated(spark, folder, view, text, **options), *labels)

    f.__name__, f.__doc__ = name, text
    query(sql)(f)


# Selectors, aggregations, arithmetic

language("selector_eq", "event_value", 'event_value{event_type="click"}', ["event_type", "user_id"], f"WITH {_EV} SELECT event_type, user_id, ts, round(value, 4) AS value FROM ev WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01'")
language("sum_by_event_type", "event_value", "sum by (event_type) (event_value)", ["event_type"], f"WITH {_EV} SELECT event_type, ts, round(sum(value), 4) AS value FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01' GROUP BY ALL")
for _op, _sql in (("sum", "sum(value)"), ("avg", "avg(value)"), ("min", "min(value)"), ("max", "max(value)"), ("count", "CAST(count(*) AS DOUBLE)")):
    language(f"{_op}_by", "lineitem_revenue", f"{_op} by (returnflag) (lineitem_revenue)", ["returnflag"], f"WITH {_REV} SELECT returnflag, ts, round({_sql}, 4) AS value FROM rev GROUP BY returnflag, ts")
language("sum_without", "lineitem_revenue", "sum without (returnflag) (lineitem_revenue)", ["linestatus"], f"WITH {_REV} SELECT linestatus, ts, round(sum(value), 4) AS value FROM rev GROUP BY linestatus, ts")
language("sum_all", "lineitem_revenue", "sum(lineitem_revenue)", [], f"WITH {_REV} SELECT ts, round(sum(value), 4) AS value FROM rev GROUP BY ts")
for _name, _op, _sql in (
    ("add", "+", "l.v + r.v"), ("sub", "-", "l.v - r.v"), ("mul", "*", "l.v * r.v"),
    ("div", "/", "CASE WHEN r.v = 0 THEN 'nan'::DOUBLE ELSE l.v / r.v END"), ("mod", "%", "CASE WHEN r.v = 0 THEN 'nan'::DOUBLE ELSE fmod(l.v, r.v) END"), ("pow", "^", "pow(l.v, r.v)"),
):
    language(f"binary_{_name}", "orders_total", f"count(orders_total) {_op} count(orders_total{{orderstatus=\"F\"}})", [], f"WITH {_ORD}, l AS (SELECT ts, CAST(count(*) AS DOUBLE) AS v FROM ord GROUP BY ts), r AS (SELECT ts, CAST(count(*) AS DOUBLE) AS v FROM ord WHERE orderstatus = 'F' GROUP BY ts) SELECT l.ts, round({_sql}, 4) AS value FROM l JOIN r ON l.ts = r.ts")
language("unary_neg", "event_value", 'max by (event_type) (-event_value{event_type="view"})', ["event_type"], f"WITH {_EV} SELECT event_type, ts, round(max(-value), 4) AS value FROM ev WHERE event_type = 'view' GROUP BY ALL")
language("number_literal", "event_value", "2 ^ 3", [], "SELECT ts, 8.0::DOUBLE AS value FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY)) AS ts)")
_BASE = "base AS (SELECT event_type, ts, value, last_value(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '21600.000001 seconds' PRECEDING) AS b, first_value(value) OVER (PARTITION BY event_type ORDER BY ts) AS v0, min(ts) OVER (PARTITION BY event_type) AS t0 FROM tot)"
_RATE = f"{_TOTAL}, {_BASE}, rated AS (SELECT event_type, ts, greatest(0, (value - coalesce(b, CASE WHEN t0 = ts - INTERVAL 6 HOUR THEN v0 END)) / 21600.0) AS r FROM base WHERE coalesce(b, CASE WHEN t0 = ts - INTERVAL 6 HOUR THEN v0 END) IS NOT NULL)"
language("rate_6h", "events_total", "rate(events_total[6h])", ["event_type"], f"WITH {_RATE} SELECT event_type, ts, round(r, 4) AS value FROM rated")
language("increase_6h", "events_total", "increase(events_total[6h])", ["event_type"], f"WITH {_RATE} SELECT event_type, ts, round(r * 21600, 4) AS value FROM rated")
language("sum_of_rate", "events_total", "sum(increase(events_total[6h]))", [], f"WITH {_RATE} SELECT ts, round(sum(r * 21600), 4) AS value FROM rated GROUP BY ts")


@query(f"WITH {_RATE} SELECT event_type, ts, round(r * 21600, 4) AS value FROM rated")
def increase_in_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same increase with each series cut into blocks of time."""
    size = 6 * 3_600_000_000
    points = ranges.rate(tables.events_total(spark, folder).select("labels", "ts", "value"), size)
    return flat(points.withColumn("value", F.col("value") * (size / 1e6)), "event_type")


# The extended language

language("matcher_not_equal", "event_value", 'count by (event_type) (event_value{event_type!="click"})', ["event_type"], f"WITH {_EV} SELECT event_type, ts, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE event_type <> 'click' GROUP BY ALL", mode="extended")
language("matcher_regex", "event_value", 'event_value{event_type=~"c.*|v.*", user_id!~"1.*"}', ["event_type", "user_id"], f"WITH {_EV} SELECT event_type, user_id, ts, round(value, 4) AS value FROM ev WHERE regexp_full_match(event_type, 'c.*|v.*') AND NOT regexp_full_match(user_id, '1.*')", mode="extended")
language("compare_filter", "event_value", "event_value > 100", ["event_type", "user_id"], f"WITH {_EV} SELECT event_type, user_id, ts, round(value, 4) AS value FROM ev WHERE value > 100", mode="extended")
language("scalar_arithmetic", "event_value", "event_value * 2 + 1", ["event_type", "user_id"], f"WITH {_EV} SELECT event_type, user_id, ts, round(value * 2 + 1, 4) AS value FROM ev", mode="extended")
language("vector_matching", "orders_total", "sum by (orderstatus, orderpriority) (orders_total) / on (orderstatus) group_left sum by (orderstatus) (orders_total)", ["orderstatus", "orderpriority"], f"WITH {_ORD}, a AS (SELECT orderstatus, orderpriority, ts, sum(value) AS v FROM ord GROUP BY ALL), b AS (SELECT orderstatus, ts, sum(value) AS v FROM ord GROUP BY ALL) SELECT a.orderstatus, orderpriority, a.ts, round(a.v / b.v, 4) AS value FROM a JOIN b ON a.orderstatus = b.orderstatus AND a.ts = b.ts", mode="extended")
language("set_and", "orders_total", 'count by (orderpriority) (orders_total) and count by (orderpriority) (orders_total{orderstatus="F"})', ["orderpriority"], f"WITH {_ORD} SELECT orderpriority, ts, CAST(count(*) AS DOUBLE) AS value FROM ord GROUP BY ALL HAVING count(*) FILTER (orderstatus = 'F') > 0", mode="extended")
language("set_unless", "orders_total", 'count by (orderpriority) (orders_total) unless count by (orderpriority) (orders_total{orderstatus="F"})', ["orderpriority"], f"WITH {_ORD} SELECT orderpriority, ts, CAST(count(*) AS DOUBLE) AS value FROM ord GROUP BY ALL HAVING count(*) FILTER (orderstatus = 'F') = 0", mode="extended")
language("set_or", "orders_total", 'sum by (orderpriority) (orders_total{orderstatus="F"}) or sum by (orderpriority) (orders_total)', ["orderpriority"], f"WITH {_ORD} SELECT orderpriority, ts, round(coalesce(sum(value) FILTER (orderstatus = 'F'), sum(value)), 4) AS value FROM ord GROUP BY ALL", mode="extended")
language("stddev_by", "lineitem_revenue", "stddev by (returnflag) (lineitem_revenue)", ["returnflag"], f"WITH {_REV} SELECT returnflag, ts, round(stddev_pop(value), 4) AS value FROM rev GROUP BY ALL", mode="extended")
language("stdvar_by", "lineitem_revenue", "stdvar by (returnflag) (lineitem_revenue / 1000)", ["returnflag"], f"WITH {_REV} SELECT returnflag, ts, round(var_pop(value / 1000), 4) AS value FROM rev GROUP BY ALL", mode="extended")
language("quantile_by", "lineitem_revenue", "quantile by (returnflag) (0.9, lineitem_revenue)", ["returnflag"], f"WITH {_REV} SELECT returnflag, ts, round(quantile_cont(value, 0.9), 4) AS value FROM rev GROUP BY ALL", mode="extended")
language("topk_by", "lineitem_revenue", "topk by (returnflag) (2, max by (returnflag, linestatus) (lineitem_revenue))", ["returnflag", "linestatus"], f"WITH {_REV}, m AS (SELECT returnflag, linestatus, ts, max(value) AS v FROM rev GROUP BY ALL) SELECT returnflag, linestatus, ts, round(v, 4) AS value FROM m QUALIFY row_number() OVER (PARTITION BY returnflag, ts ORDER BY v DESC, linestatus) <= 2", mode="extended")
language("bottomk_all", "lineitem_revenue", "bottomk(1, min by (returnflag, linestatus) (lineitem_revenue))", ["returnflag", "linestatus"], f"WITH {_REV}, m AS (SELECT returnflag, linestatus, ts, min(value) AS v FROM rev GROUP BY ALL) SELECT returnflag, linestatus, ts, round(v, 4) AS value FROM m QUALIFY row_number() OVER (PARTITION BY ts ORDER BY v, linestatus, returnflag) <= 1", mode="extended")
language("count_values", "orders_total", 'count_values("orders", count by (orderpriority) (orders_total))', ["orders"], f"WITH {_ORD}, c AS (SELECT orderpriority, ts, count(*) AS n FROM ord GROUP BY ALL) SELECT CAST(n AS VARCHAR) AS orders, ts, CAST(count(*) AS DOUBLE) AS value FROM c GROUP BY n, ts", mode="extended")
language("offset_day", "event_value", "max by (event_type) (event_value offset 1d)", ["event_type"], f"WITH {_EV} SELECT event_type, ts + INTERVAL 1 DAY AS ts, round(max(value), 4) AS value FROM ev WHERE ts + INTERVAL 1 DAY BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01' GROUP BY ALL", mode="extended")
language("max_over_time", "event_value", "max_over_time(event_value[6h])", ["event_type", "user_id"], f"WITH {_EV} SELECT event_type, user_id, ts, round(max(value) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999 seconds' PRECEDING AND CURRENT ROW), 4) AS value FROM ev", mode="extended")
language("subquery_max", "event_value", "max_over_time(count(event_value)[6h:1h])", [], f"WITH {_EV}, c AS (SELECT ts, CAST(count(*) AS DOUBLE) AS v FROM ev GROUP BY ts), p AS (SELECT max(ts) AS ts, arg_max(v, ts) AS v FROM c GROUP BY time_bucket(INTERVAL 1 HOUR, ts)) SELECT ts, max(v) OVER (ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999 seconds' PRECEDING AND CURRENT ROW) AS value FROM p", mode="extended")


# Rollups and retention

def _rolled(df: DataFrame) -> DataFrame:
    return df.select(model.label("event_type").alias("event_type"), "ts", F.round("agg.sum", 4).alias("sum"), F.col("agg.count").alias("count"), F.round("agg.min", 4).alias("min"), F.round("agg.max", 4).alias("max"), rounded().alias("value"))


def _by_type(spark: SparkSession, folder: str) -> DataFrame:
    return tables.event_value(spark, folder).withColumn("labels", F.map_filter("labels", lambda k, v: k == "event_type"))


_ROLL = "SELECT event_type, time_bucket(INTERVAL '{m} minutes', ts) AS ts, round(sum(value), 4) AS sum, count(*) AS count, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS value FROM events GROUP BY event_type, time_bucket(INTERVAL '{m} minutes', ts)"


@query(_ROLL.format(m=5))
def rollup_5m(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled(rollup.five_minutes(_by_type(spark, folder)))


@query(_ROLL.format(m=60))
def rollup_1h(spark: SparkSession, folder: str) -> DataFrame:
    return _rolled(rollup.one_hour(rollup.five_minutes(_by_type(spark, folder))))


@query("SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, '5m' AS resolution, printf('%.6f', min(value)) AS low, CAST(count(*) AS VARCHAR) AS count FROM events GROUP BY event_type, time_bucket(INTERVAL 5 MINUTE, ts)")
def rollup_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Rollups as labels, and read back from them."""
    written = rollup.with_internal_labels(rollup.five_minutes(_by_type(spark, folder)))
    back = rollup.from_internal_labels(written.drop("agg", "resolution"))
    return back.select(model.label("event_type").alias("event_type"), "ts", "resolution", F.format_string("%.6f", "agg.min").alias("low"), F.col("agg.count").cast("string").alias("count"))


@query("SELECT event_id, ts FROM events WHERE NOT ts < TIMESTAMP '2024-01-15'")
def retention_keep(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.read(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("").alias("resolution"))
    return rollup.kept(rows, datetime(2024, 1, 15, tzinfo=UTC), model.RAW).select("event_id", "ts")


_NOW = datetime(2024, 1, 20, tzinfo=UTC)


@query(
    """WITH kept AS (SELECT '' AS resolution, ts, value AS s, 1 AS n FROM events WHERE ts >= TIMESTAMP '2024-01-19 18:00:00'),
    five AS (SELECT '5m' AS resolution, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, sum(value) AS s, count(*) AS n FROM events
      WHERE ts >= TIMESTAMP '2024-01-19 12:00:00' AND ts < TIMESTAMP '2024-01-19 18:00:00' GROUP BY event_type, time_bucket(INTERVAL 5 MINUTE, ts))
    SELECT resolution, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS samples, round(sum(s), 3) AS total FROM (SELECT * FROM kept UNION ALL SELECT * FROM five) GROUP BY resolution"""
)
def compaction_run(spark: SparkSession, folder: str) -> DataFrame:
    """What one run of compaction leaves, by resolution."""
    left = rollup.compacted(model.samples(_by_type(spark, folder)), _NOW)
    return left.groupBy("resolution").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce("agg.count", F.lit(1))).alias("samples"), F.round(F.sum(F.coalesce("agg.sum", "value")), 3).alias("total"))


@query("SELECT event_type, round(quantile_cont(value, 0.99), 4) AS p99, round(quantile_cont(value, 0.5), 4) AS p50 FROM events GROUP BY event_type")
def exact_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    df = tables.read(spark, folder, "events")
    return df.groupBy("event_type").agg(F.round(scalars.percentile("value", 0.99), 4).alias("p99"), F.round(scalars.percentile("value", 0.5), 4).alias("p50"))


# Charts and statistics

@query(
    """WITH p AS (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, min(ts) AS ts, round(avg(value), 4) AS value FROM p GROUP BY event_type, i // greatest(1, CASE WHEN n > 100 THEN n // 100 ELSE 1 END)"""
)
def chart_downsample(spark: SparkSession, folder: str) -> DataFrame:
    return flat(chart.range_points(_by_type(spark, folder), "event_value", *EVENTS, points=100), "event_type")


@query("SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, max(ts) AS ts, round(arg_max(value, (ts, value)), 4) AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11' GROUP BY event_type, user_id")
def instant_last(spark: SparkSession, folder: str) -> DataFrame:
    span = (datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 11, tzinfo=UTC))
    return flat(chart.latest_points(evaluated(spark, folder, "event_value", "event_value", span)), "event_type", "user_id")


@query("SELECT count(*) AS total_samples, count(DISTINCT (event_type, user_id)) AS total_series, min(ts) AS oldest, max(ts) AS newest, count(*) * 100 AS bytes FROM events")
def store_stats(spark: SparkSession, folder: str) -> DataFrame:
    return store.statistics(tables.event_value(spark, folder))


@query(
    """WITH s AS (SELECT DISTINCT 'event_value' AS name, event_type AS a, CAST(user_id AS VARCHAR) AS b FROM events UNION ALL SELECT DISTINCT 'lineitem_revenue', l_returnflag, l_linestatus FROM lineitem),
    c AS (SELECT name, count(*) AS n FROM s GROUP BY name) SELECT CAST(sum(n) AS BIGINT) AS total_series, count(*) AS unique_metrics, arg_max(name, (n, name)) AS largest_metric, max(n) AS largest_count, round(sum(n) * 100.0 / 100000, 6) AS utilization FROM c"""
)
def cardinality(spark: SparkSession, folder: str) -> DataFrame:
    both = tables.event_value(spark, folder).unionByName(tables.lineitem_revenue(spark, folder))
    return ingest.cardinality(both).withColumn("utilization", F.round("utilization", 6))


@query(
    """WITH known AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts < TIMESTAMP '2024-01-05'), fresh AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05')
    SELECT event_type, CAST(user_id AS VARCHAR) AS user_id FROM (SELECT * FROM fresh EXCEPT SELECT * FROM known)"""
)
def new_series(spark: SparkSession, folder: str) -> DataFrame:
    rows, cut = tables.event_value(spark, folder), F.col("ts") < F.lit("2024-01-05").cast("timestamp")
    known = ingest.new_series(rows.where(cut), spark.createDataFrame([], "name string, series array<struct<key:string,value:string>>"))
    labels = F.map_from_entries("series")
    return ingest.new_series(rows.where(~cut), known).select(model.label("event_type", labels).alias("event_type"), model.label("user_id", labels).alias("user_id"))


@query("SELECT name FROM (VALUES ('event_value'), ('lineitem_revenue'), ('orders_total')) t(name)")
def metric_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = [tables.VIEWS[v](spark, folder) for v in ("event_value", "lineitem_revenue", "orders_total")]
    return chart.names(rows[0].unionByName(rows[1]).unionByName(rows[2]), DAYS[0], EVENTS[1], None)


@query("SELECT key FROM (VALUES ('event_type'), ('user_id'), ('returnflag'), ('linestatus')) t(key)")
def label_keys(spark: SparkSession, folder: str) -> DataFrame:
    return exchange.label_keys(tables.event_value(spark, folder).unionByName(tables.lineitem_revenue(spark, folder)))


@query("SELECT event_type, CAST(sum(v) AS BIGINT) AS total FROM (SELECT event_type, CAST(trunc(arg_max(value, (ts, value))) AS BIGINT) AS v FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-15' GROUP BY event_type, user_id) GROUP BY event_type")
def latest_total(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.event_value(spark, folder).withColumn("name", model.label("event_type"))
    return chart.latest_total(rows, datetime(2024, 1, 15, tzinfo=UTC), timedelta(days=1)).select(F.col("name").alias("event_type"), "total")


# Storage, ingest, exchange

@query("SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, l_shipdate AS ts, round(arg_max(l_extendedprice * (1 - l_discount), (l_orderkey * 10 + l_linenumber, l_extendedprice * (1 - l_discount))), 4) AS value FROM lineitem GROUP BY ALL")
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last of several writes of a series at one time."""
    view = tables.read(spark, folder, "lineitem").select(
        F.lit("lineitem_revenue").alias("name"), F.lit("").alias("resolution"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"),
        F.create_map(F.lit("returnflag"), "l_returnflag", F.lit("linestatus"), "l_linestatus").alias("labels"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_s"),
    ).withColumn("_seq", F.struct("_s", "value"))
    return flat(store.latest(view, "_seq"), "returnflag", "linestatus")


@query("SELECT event_id, ts, round(value, 4) AS value FROM events ORDER BY event_type, ts LIMIT 50")
def scan_limit(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows in the store's order."""
    rows = tables.read(spark, folder, "events").select("event_id", F.lit("event_value").alias("name"), F.create_map(F.lit("event_type"), "event_type").alias("labels"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return store.matching(rows, names=["event_value"], limit=50).select("event_id", "ts", rounded().alias("value"))


_LONG = "repeat('n', CASE WHEN event_id % 7 = 0 THEN 300 WHEN event_id % 11 = 0 THEN 0 ELSE 5 END)"


@query(f"SELECT event_id, CASE WHEN {_LONG} = '' THEN 'metric name cannot be empty' WHEN length({_LONG}) > 256 THEN 'metric name too long' WHEN event_id % 5 = 0 THEN 'label value too long' END AS error FROM events")
def validate_ingest(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    rows = tables.read(spark, folder, "events").select(
        "event_id", F.repeat(F.lit("n"), F.when(n % 7 == 0, 300).when(n % 11 == 0, 0).otherwise(5)).alias("name"), F.create_map(F.lit("k"), F.repeat(F.lit("v"), F.when(n % 5 == 0, 1025).otherwise(1024))).alias("labels")
    )
    return rows.select("event_id", ingest.error().alias("error"))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'm' END AS name, CASE WHEN event_id % 7 = 0 THEN 'summary' ELSE 'gauge' END AS type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS ts FROM events)
    SELECT event_id, CASE WHEN name = '' THEN 'metric name cannot be empty' WHEN type <> 'gauge' THEN 'invalid metric type: "summary"' WHEN ts IS NULL THEN 'metric timestamp cannot be zero'
    WHEN ts > TIMESTAMP '2024-01-16' THEN 'timestamp too far in future' END AS error FROM e"""
)
def import_validation(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    rows = tables.read(spark, folder, "events").select("event_id", F.when(n % 13 == 0, "").otherwise("m").alias("name"), F.when(n % 7 == 0, "summary").otherwise("gauge").alias("type"), F.when(n % 17 != 0, F.col("ts").cast("timestamp")).alias("ts"))
    return rows.select("event_id", ingest.import_error(datetime(2024, 1, 15, tzinfo=UTC)).alias("error"))


@query(
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 'event_value' AS name, 'gauge' AS type, regexp_replace(CAST(value AS VARCHAR), '[.]0$', '') AS value, '' AS endpoint, event_type, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS user_id FROM events"""
)
def csv_flatten(spark: SparkSession, folder: str) -> DataFrame:
    view = tables.read(spark, folder, "events").select(
        F.lit("event_value").alias("name"), F.lit("gauge").alias("type"), "value", F.col("ts").cast("timestamp").alias("ts"),
        F.map_filter(F.create_map(F.lit("event_type"), "event_type", F.lit("user_id"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string"))), lambda k, v: v.isNotNull()).alias("labels"),
    )
    return exchange.csv_rows(view, ["endpoint", "event_type", "user_id"])


@query("SELECT event_id, printf('%.6f', value) AS value FROM events")
def response_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values as the query interface prints them."""
    return tables.read(spark, folder, "events").select("event_id", scalars.six_decimals(F.col("value")).alias("value"))


# Instruments

@query("SELECT event_id, event_type, round(sum(greatest(value, 0)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS total FROM events WHERE value >= 0")
def counter_running(spark: SparkSession, folder: str) -> DataFrame:
    steps = tables.read(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    return instruments.counter(steps, ["event_type"], ["ts", "event_id"]).select("event_id", "event_type", F.round("total", 3).alias("total"))


@query(
    """WITH o AS (SELECT event_id, event_type, ts, value, CASE WHEN event_id % 50 = 0 THEN 'set' WHEN event_id % 3 = 0 THEN 'sub' WHEN event_id % 3 = 1 THEN 'inc' ELSE 'add' END AS op FROM events),
    g AS (SELECT *, count(*) FILTER (op = 'set') OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM o)
    SELECT event_id, round(sum(CASE op WHEN 'sub' THEN -value WHEN 'inc' THEN 1.0 ELSE value END) OVER (PARTITION BY event_type, s ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS gauge FROM g"""
)
def gauge_running(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("event_id")
    op = F.when(n % 50 == 0, "set").when(n % 3 == 0, "sub").when(n % 3 == 1, "inc").otherwise("add")
    events = tables.read(spark, folder, "events").select("event_id", "event_type", "ts", "value", op.alias("op"))
    return instruments.gauge(events, ["event_type"], ["ts", "event_id"]).select("event_id", F.round("gauge", 3).alias("gauge"))


@query(
    """WITH b(le, bound) AS (VALUES ('0.001', 0.001), ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1', 1.0), ('2.5', 2.5), ('5', 5.0), ('+Inf', 10.0))
    SELECT event_type, 'bucket' AS part, le, CAST(count(*) FILTER (value / 10 <= bound) AS DOUBLE) AS value FROM events, b GROUP BY event_type, le
    UNION ALL SELECT event_type, 'sum', NULL, round(sum(value / 10), 3) FROM events GROUP BY event_type UNION ALL SELECT event_type, 'count', NULL, CAST(count(*) AS DOUBLE) FROM events GROUP BY event_type"""
)
def histogram_buckets(spark: SparkSession, folder: str) -> DataFrame:
    values = tables.read(spark, folder, "events").select("event_type", (F.col("value") / 10).alias("value"))
    return instruments.histogram(values, ["event_type"]).select("event_type", "part", "le", F.round("value", 3).alias("value"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '/{id}', 'g'), '/[0-9]+', '/{id}', 'g') AS path FROM pages")
def normalize_path(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, "pages").select("page_id", scalars.normal_path(F.col("url")).alias("path"))


# Insights

_HALVES = "WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), h AS (SELECT event_type, avg(value) FILTER (i <= n // 2) AS a, avg(value) FILTER (i > n // 2) AS b FROM p GROUP BY event_type)"


@query(f"{_HALVES} SELECT event_type, round(CASE WHEN a IS NULL OR a = 0 THEN 0 ELSE (b - a) / a END, 6) AS trend FROM h")
def trend(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.read(spark, folder, "events").select("event_type", "ts", "event_id", "value")
    return insights.trend(rows, ["event_type"], ["ts", "event_id"]).select("event_type", F.round("trend", 6).alias("trend"))


@query(
    f"""{_HALVES}, t AS (SELECT event_type, CASE WHEN a IS NULL OR a = 0 THEN 0 ELSE (b - a) / a END AS t FROM h), s AS (SELECT event_type, arg_max(value, (ts, value)) AS v FROM events GROUP BY event_type)
    SELECT event_type, CASE event_type WHEN 'click' THEN CASE WHEN v >= 90 THEN 'Critical' WHEN v >= 70 THEN 'Warning' ELSE 'Healthy' END WHEN 'view' THEN CASE WHEN v >= 500 THEN 'Critical' WHEN v >= 100 THEN 'Warning' ELSE 'Healthy' END
    ELSE CASE WHEN abs(t) < 0.05 THEN 'Stable' WHEN t > 0.2 THEN 'Rising' WHEN t < -0.2 THEN 'Declining' ELSE 'Stable' END END AS status FROM t JOIN s USING (event_type)"""
)
def metric_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.read(spark, folder, "events").select("event_type", "ts", "event_id", "value")
    both = insights.summary(rows, ["event_type"]).join(insights.trend(rows, ["event_type"], ["ts", "event_id"]), "event_type")
    name = F.when(F.col("event_type") == "click", "host_cpu_usage").when(F.col("event_type") == "view", "latency_ms").otherwise(F.col("event_type"))
    return both.select("event_type", insights.status(name, F.col("avg"), F.col("latest"), F.col("trend")).alias("status"))


@query("SELECT event_type, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS avg, count(DISTINCT user_id) AS series, count(*) AS points FROM events GROUP BY event_type")
def summary_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.event_value(spark, folder).withColumn("event_type", model.label("event_type"))
    found = insights.statistics(rows, ["event_type"])
    return found.select("event_type", *(F.round(c, 4).alias(c) for c in ("min", "max", "avg")), "series", "points")


_DAILY = "d AS (SELECT event_type, date_trunc('day', ts) AS ts, count(*) AS v FROM events GROUP BY ALL)"


@query(f"WITH {_DAILY} SELECT a.event_type, a.ts, a.v AS value, b.v AS before FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND a.ts = b.ts + INTERVAL 24 HOUR")
def compare_24h(spark: SparkSession, folder: str) -> DataFrame:
    daily = tables.read(spark, folder, "events").groupBy("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).agg(F.count(F.lit(1)).alias("value"))
    return insights.compared(daily, ["event_type"])


@query("SELECT 'events' AS service, event_type AS endpoint FROM events GROUP BY event_type")
def service_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.read(spark, folder, "events").select(F.create_map(F.lit("__service"), F.lit("events"), F.lit("path"), F.col("event_type")).alias("labels"))
    return insights.services(rows).select("service", F.explode("endpoints").alias("endpoint"))


@query("SELECT name, kind, system FROM (VALUES ('go_gc_count', 'counter', true), ('http_duration', 'histogram', false), ('cpu_usage', 'gauge', false), ('requests_total', 'counter', false)) t(name, kind, system)")
def guessed_kinds(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([("go_gc_count",), ("http_duration",), ("cpu_usage",), ("requests_total",)], "name string")
    return rows.select("name", insights.kind().alias("kind"), insights.is_system().alias("system"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of events by type: selector, range function and aggregation in one plan."""
    return flat(evaluated(spark, folder, "events_total", "sum by (event_type) (increase(events_total[6h]))"), "event_type")
