import json
from datetime import timedelta

import pytest
from moments import T0
from pyspark.sql import functions as F

from tidemark import model
from tidemark.api import QueryApi, StoreApi, go_duration
from tidemark.functions import scalars
from tidemark.operators import chart, ingest, insights, instruments, rollup
from tidemark.sources import exchange
from tidemark.sources.store import SampleStore, StoreFull, in_order, latest, matching, statistics

H, M, S = timedelta(hours=1), timedelta(minutes=1), timedelta(seconds=1)


def test_rollups(make):
    one = rollup.five_minutes(make(*[("cpu", 60 * k, v, {}) for k, v in enumerate((10, 20, 30, 40))])).collect()
    assert len(one) == 1 and one[0]["value"] == 25 and one[0]["agg"].asDict() == {"sum": 100.0, "count": 4, "min": 10.0, "max": 40.0}
    assert one[0]["ts"].timestamp() == T0.timestamp() and one[0]["type"] == "gauge" and one[0]["resolution"] == "5m"
    two = make(("m", 0, 10, {}), ("m", 180, 20, {}), ("m", 360, 30, {}), ("m", 480, 40, {}))
    assert rollup.five_minutes(two).count() == 2
    hours = make(*[("m", t, v, {"a": "b", "_i": "x"}) for t, v in ((0, 10), (300, 15), (600, 20), (900, 25), (3600, 30))])
    rolled = {r["ts"].timestamp() - T0.timestamp(): r for r in rollup.one_hour(rollup.five_minutes(hours)).collect()}
    assert {t: r["value"] for t, r in rolled.items()} == {0.0: 17.5, 3600.0: 30.0} and rolled[0.0]["labels"] == {"a": "b"}
    with pytest.raises(ValueError):
        rollup.five_minutes(two, T0, T0)


def test_rollup_labels_round_trip(make):
    rolled = rollup.five_minutes(make(("m", 0, 1.25, {"a": "b"}), ("m", 1, 2, {"a": "b"})))
    written = rollup.with_internal_labels(rolled)
    assert written.first()["labels"]["__sum__"] == "3.250000" and written.first()["labels"]["__resolution__"] == "5m"
    back = rollup.from_internal_labels(written.drop("agg", "resolution")).first()
    assert back["agg"]["sum"] == 3.25 and back["labels"] == {"a": "b"} and back["resolution"] == "5m"
    bad = rollup.from_internal_labels(make(("m", 0, 1, {"__resolution__": "5m", "__sum__": "x"}))).first()
    assert bad["agg"] is None


def test_compaction_twice_is_once(make):
    now = T0 + 8 * H
    df = make(*[("m", 60 * k, k, {"a": "b"}) for k in range(480)])
    once = rollup.compacted(df, now)
    assert once.where("resolution = ''").count() == 360 and once.where("resolution = '5m'").count() == 24
    assert sorted(map(str, rollup.compacted(once, now).collect())) == sorted(map(str, once.collect()))


@pytest.mark.parametrize("minutes, given, floor", [(5, 30, 0), (5, 225, 0), (5, 459, 300), (5, 899, 600), (60, 3599, 0)])
def test_floors(spark, minutes, given, floor):
    df = spark.createDataFrame([(T0 + given * S,)], "ts timestamp")
    assert df.select(scalars.floor_to(F.col("ts"), minutes).alias("t")).first()[0].timestamp() == (T0 + floor * S).timestamp()


def test_percentile(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1, 11)], "v double")
    assert [round(df.select(scalars.percentile("v", p)).first()[0], 2) for p in (0, 0.5, 0.99, 1)] == [1, 5.5, 9.91, 10]
    assert df.where("v > 99").select(scalars.percentile("v", 0.5)).first()[0] == 0


def test_filters_and_statistics(make):
    df = make(("http", 0, 1, {"endpoint": "/api"}), ("http", 60, 2, {"endpoint": "/health"}), ("memory", 0, 1024, {"host": "s1"}))
    assert matching(df, names=["http"]).count() == 2 and matching(df, labels={"endpoint": "/api"}).count() == 1
    assert matching(df, T0, T0, limit=1).count() == 1 and [r["name"] for r in in_order(df).collect()] == ["http", "http", "memory"]
    found = statistics(df).first()
    assert (found["total_samples"], found["total_series"], found["bytes"]) == (3, 3, 300)


def test_latest_keeps_the_last_write(make):
    df = make(("m", 0, 1, {"a": "b"}), ("m", 0, 2, {"a": "b"}), ("m", 0, 3, None), ("m", 0, 4, {})).withColumn("_seq", F.col("value"))
    assert sorted(r["value"] for r in latest(df, "_seq").collect()) == [2.0, 4.0]


def test_store(spark, make, tmp_path):
    store = SampleStore(spark, str(tmp_path / "s"))
    assert store.samples().count() == 0
    store.write(make(("m", 0, 1, {"a": "b"}), ("m", 60, 2, {"a": "b"})))
    store.write(make(("m", 0, 9, {"a": "b"}), ("old", -90_000, 5, {})))
    assert sorted(r["value"] for r in store.query(names=["m"]).collect()) == [2.0, 9.0]
    assert store.query(T0 - S, T0 + S).count() == 1
    assert store.delete(T0 - H) == 1 and store.samples().count() == 2
    store.compact()
    assert sorted(r["value"] for r in store.samples().collect()) == [2.0, 9.0]
    assert store.delete(T0 + S, "5m") == 0
    capped = SampleStore(spark, str(tmp_path / "c"), upsert=False, max_samples=3)
    capped.write(make(("m", 0, 1, {}), ("m", 0, 1, {})))
    assert capped.samples().count() == 2  # duplicates stay
    with pytest.raises(StoreFull):
        capped.write(make(("m", 1, 1, {}), ("m", 2, 1, {})))


@pytest.mark.parametrize("n, limit", [(10, 10), (1999, 1000), (2500, 1000), (101, 10), (7, 3)])
def test_downsample(spark, n, limit):
    df = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("value"))
    got = [(r["ts"].timestamp(), r["value"]) for r in chart.downsampled(df, ["k"], limit).orderBy("ts").collect()]
    size = n // limit if n > limit else 1
    chunks = [list(range(k, min(k + size, n))) for k in range(0, n, size)]
    assert got == [(c[0], sum(c) / len(c)) for c in chunks]


def test_chart_and_instant(make):
    df = make(("m", 0, 1, {"a": "b", "_x": "1"}), ("m", 10, 3, {"a": "b", "_x": "2"}), ("m", 20, 5, {"a": "c"}))
    api = QueryApi(df, clock=lambda: T0 + M)
    series = {r["labels"]["a"]: r["points"] for r in api.chart("m", T0, T0 + H).collect()}
    assert [(p["t"] - int(T0.timestamp() * 1000), p["v"]) for p in series["b"]] == [(0, 1.0), (10_000, 3.0)]
    assert {r["metric"]["a"]: r["values"][0]["v"] for r in api.instant('m{a="c"}').collect()} == {"c": "5.000000"}
    got = api.query_range("sum(m)", str(T0.timestamp()), "2024-01-01T12:01:00Z", "15").first()
    assert [(v["t"] - int(T0.timestamp()), v["v"]) for v in got["values"]] == [(0, "1.000000"), (10, "3.000000"), (20, "5.000000")]
    assert [r[0] for r in api.names().collect()] == ["m"] and api.raw("m").count() == 3
    for bad in ((T0, T0 - S, 10), (T0, T0 + 100 * 24 * H, 10), (T0, T0 + H, 0)):
        with pytest.raises(ValueError):
            api.chart("m", *bad)
    with pytest.raises(ValueError):
        api.execute("m", T0, T0)
    assert go_duration("1m30s") == timedelta(seconds=90)


def test_limits(make):
    many = {f"k{i}": "v" for i in range(20)}
    rows = [("ok", {}, None), ("", {}, "metric name cannot be empty"), ("n" * 257, {}, "metric name too long"), ("m", many | {"z": "v"}, "too many labels"), ("m", {"k" * 257: "v"}, "label key too long"), ("m", {"k": "é" * 513}, "label value too long"), ("m", many, None)]
    got = make(*[(n, k, 0, labels) for k, (n, labels, _) in enumerate(rows)]).withColumn("e", ingest.error()).orderBy("ts").collect()
    assert [r["e"] for r in got] == [e for _, _, e in rows]


def test_requests(spark, make, tmp_path):
    api = StoreApi(SampleStore(spark, str(tmp_path / "s")), clock=lambda: T0)
    body = {"metrics": [{"name": "a", "type": "gauge", "value": 1, "labels": {"x": "y"}}, {"name": "b", "type": "gauge", "value": 2, "timestamp": "2024-01-01T11:00:00Z"}]}
    assert api.ingest(json.dumps(body)) == 2 and {r["ts"].timestamp() - T0.timestamp() for r in api.store.samples().collect()} == {0.0, -3600.0}
    for metrics, status in (([{"name": "a", "value": 1}] * 1001, 400), ([{"name": "a", "value": 1}, {"name": "", "value": 1}], 400)):
        with pytest.raises(ingest.Rejected) as e:
            api.ingest(json.dumps({"metrics": metrics}))
        assert e.value.status == status
    full = StoreApi(api.store, lambda: T0, ingest.Quota(lambda: 10, 10, lambda: 0.0))
    with pytest.raises(ingest.Rejected) as e:
        full.ingest(json.dumps(body))
    assert e.value.status == 507


def test_cardinality(spark, make):
    df = make(("cpu", 0, 1, {"host": "a", "__resolution__": "5m"}), ("cpu", 0, 1, {"host": "a", "__resolution__": "1h"}), ("cpu", 0, 1, {"host": "b"}), ("mem", 0, 1, None))
    found = ingest.cardinality(df).first()
    assert (found["total_series"], found["unique_metrics"], found["largest_metric"], found["largest_count"]) == (3, 2, "cpu", 2)
    known = df.select("name", ingest.cardinality_key().alias("series")).distinct()
    batch = make(("cpu", 0, 1, {"host": "c"}), ("cpu", 0, 1, {"host": "a"}), ("disk", 0, 1, {}))
    assert ingest.new_series(batch, known).count() == 2
    assert {r["name"]: r["error"] for r in ingest.cardinality_errors(batch, known, limit_of_name=2).collect()} == {"cpu": "metric cardinality limit exceeded"}
    assert {r["error"] for r in ingest.cardinality_errors(batch, known, limit=3).collect()} == {"cardinality limit exceeded"}
    assert ingest.expired(ingest.series_seen(df), T0 + 25 * H).count() == 3


def test_exchange(spark, make, tmp_path):
    df = make(("http", 0, 100, {"service": "s", "endpoint": "e"}), ("http", 60, 200.5, {"service": "s", "endpoint": "e", "status": "200"}))
    assert exchange.export_csv(df, str(tmp_path / "csv")) == ["endpoint", "service", "status"]
    lines = [r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert "timestamp,name,type,value,endpoint,service,status" in lines and "2024-01-01T12:01:00Z,http,gauge,200.5,e,s,200" in lines and "2024-01-01T12:00:00Z,http,gauge,100,e,s," in lines
    assert exchange.export_json(df, str(tmp_path / "json"), T0, T0 + H, T0) == 2
    store = SampleStore(spark, str(tmp_path / "s"))
    found = exchange.import_json(store, str(tmp_path / "json" / "metrics"), T0, lines=True)
    assert found["imported"] == 2 and found["batches"] == 1
    assert sorted(map(str, store.samples().select(*model.SAMPLES.fieldNames()[:5]).collect())) == sorted(map(str, df.select(*model.SAMPLES.fieldNames()[:5]).collect()))
    document = json.loads(exchange.json_document(df, T0, T0 + H, T0).first()[0])
    assert document["metadata"]["metric_count"] == 2 and document["metadata"]["version"] == "1.0" and len(document["metrics"]) == 2


def test_import_checks(spark, tmp_path):
    metrics = [{"name": "ok", "type": "gauge", "value": 1, "timestamp": "2024-01-01T12:00:00Z"}, {"name": "", "type": "gauge", "value": 1, "timestamp": "2024-01-01T12:00:00Z"}, {"name": "x", "type": "bad", "value": 1, "timestamp": "2024-01-01T12:00:00Z"}, {"name": "x", "type": "gauge", "value": 1, "timestamp": "2024-01-03T12:00:00Z"}]
    (tmp_path / "d.json").write_text(json.dumps({"metadata": {"version": "1.0"}, "metrics": metrics}, indent=1))
    store = SampleStore(spark, str(tmp_path / "s"))
    found = exchange.import_json(store, str(tmp_path / "d.json"), T0)
    assert found["imported"] == 1 and found["errors"] == 3
    assert found["messages"] == ["metric 1: metric name cannot be empty", 'metric 2: invalid metric type: "bad"', "metric 3: timestamp too far in future"]


def test_instruments(spark, make):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, -5.0), ("a", 3, 3.0)], "k string, t int, value double")
    assert [r["total"] for r in instruments.counter(df, ["k"], ["t"]).orderBy("t").collect()] == [2.0, 5.0]
    ops = spark.createDataFrame([("a", 1, "set", 5.0), ("a", 2, "inc", None), ("a", 3, "sub", 2.0), ("a", 4, "set", 1.0), ("a", 5, "dec", None)], "k string, t int, op string, value double")
    assert [r["gauge"] for r in instruments.gauge(ops, ["k"], ["t"]).orderBy("t").collect()] == [5.0, 6.0, 4.0, 1.0, 0.0]
    seen = spark.createDataFrame([("a", v) for v in (0.001, 0.3, 10.0, 11.0)], "k string, value double")
    got = {(r["part"], r["le"]): r["value"] for r in instruments.histogram(seen, ["k"]).collect()}
    assert got[("bucket", "0.001")] == 1 and got[("bucket", "0.5")] == 2 and got[("bucket", "+Inf")] == 3 and got[("count", None)] == 4 and got[("sum", None)] == pytest.approx(21.301)
    true = {(r["part"], r["le"]): r["value"] for r in instruments.histogram(seen, ["k"], true_infinity=True).collect()}
    assert true[("bucket", "10")] == 3 and true[("bucket", "+Inf")] == 4
    flushed = instruments.flushed(make(("x", 0, 0.2, {}), ("x", 20, 0.2, {})), "req")
    assert {(r["name"], r["value"]) for r in flushed.where("name = 'req_count'").collect()} == {("req_count", 1.0)} and flushed.where("name = 'req_bucket'").count() == 24
    assert instruments.stamped(make(("m", 0, 1, None)), "api").first()["labels"] == {"service": "api"}
    assert spark.range(1).select(instruments.label_pairs("a", "1", "b").alias("l")).first()[0] is None


@pytest.mark.parametrize("path, normal", [("/api/users/123", "/api/users/{id}"), ("/posts/456/comments/789", "/posts/{id}/comments/{id}"), ("/u/550e8400-E29B-41d4-a716-446655440000/x", "/u/{id}/x"), ("/api/users", "/api/users"), ("/", "/"), ("", "")])
def test_paths(spark, path, normal):
    assert spark.createDataFrame([(path,)], "p string").select(scalars.normal_path(F.col("p"))).first()[0] == normal


def test_insights(spark, make):
    rows = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate((1, 1, 3, 3, 3))] + [("b", 0, 1.0), ("c", 0, 0.0), ("c", 1, 5.0)], "k string, t int, value double")
    assert {r["k"]: round(r["trend"], 6) for r in insights.trend(rows, ["k"], ["t"]).collect()} == {"a": 2.0, "b": 0.0, "c": 0.0}
    cases = [("x_cpu_usage", 95.0, 0.0, "Critical"), ("x_cpu_usage", 70.0, 0.0, "Warning"), ("x", 1.0, 0.5, "Rising"), ("x", 1.0, -0.5, "Declining"), ("x", 1.0, 0.1, "Stable"), ("X_LATENCY", 5.0, 9.0, "Healthy")]
    df = spark.createDataFrame(cases, "n string, v double, t double, s string")
    assert all(r["s"] == r["got"] for r in df.withColumn("got", insights.status(F.col("n"), F.col("v"), F.col("v"), F.col("t"))).collect())
    m = make(("go_x", 0, 1, {"service": "s", "endpoint": "/e", "path": "/p"}), ("y_total", 0, 2, {"__service": "z"}), ("w", 0, 3, None))
    assert {r["service"]: r["endpoints"] for r in insights.services(m).collect()} == {"s": ["/e", "/p"], "z": [], "default": []}
    assert [r["name"] for r in insights.browse(m, system=False, only_kind="counter").collect()] == ["y_total"]
    days = make(("m", 0, 1, {"a": "b"}), ("m", 86_400, 5, {"a": "b"})).select(model.series_key().alias("k"), "ts", "value")
    assert sorted((r["value"], r["before"]) for r in insights.compared(days, ["k"]).collect() if r["before"] is not None) == [(5.0, 1.0)]
    assert insights.overlaid(days).count() == 4
    assert insights.long_csv(m.where("name = 'go_x'")).first()["Series"] == "endpoint=/e, path=/p, service=s"
