"""The store's promises: replacement that survives a lost writer, numbers of writes, series, compaction; and series longer than a piece or block."""

import random
from datetime import timedelta

import pytest
from moments import T0
from pyspark.sql import functions as F

from tidemark import model
from tidemark.api import StoreApi
from tidemark.functions import ranges, scalars
from tidemark.operators import ingest, instruments, rollup, running
from tidemark.sources import exchange
from tidemark.sources.store import SampleStore
from tidemark.streaming import flow

S, H = timedelta(seconds=1), timedelta(hours=1)


def test_a_day_whose_replacement_broke_off_comes_back(spark, make, tmp_path):
    store = SampleStore(spark, str(tmp_path / "s"))
    store.write(make(("m", 0, 1, {"a": "b"}), ("m", 60, 2, {"a": "b"})))
    place = tmp_path / "s" / "res=raw" / f"event_date={T0.date()}"
    aside = tmp_path / "s" / "_old-x" / "res=raw"
    aside.mkdir(parents=True)
    place.rename(aside / place.name)  # the old day is moved aside, the new one not yet in its place
    (tmp_path / "s" / "_new-x").mkdir()
    assert store.recover() == 1 and store.samples().count() == 2
    assert not any(p.name.startswith(("_old", "_new")) for p in (tmp_path / "s").iterdir())


def test_writers_get_numbers_of_their_own(spark, make, tmp_path):
    one, two = (SampleStore(spark, str(tmp_path / "s")) for _ in range(2))
    assert [one._ticket(), two._ticket(), one._ticket()] == [1, 2, 3]
    one.write(make(("m", 0, 5, {})))
    two.write(make(("m", 0, 1, {})))
    assert [r["value"] for r in one.samples().collect()] == [1.0]


def test_labels_are_looked_at_before_the_newest_rows_are_chosen(spark, make, tmp_path):
    store = SampleStore(spark, str(tmp_path / "s"))
    store.write(make(("m", 0, 5, {"a": "b"}), ("m", 0, 6, {"a": "c"})))
    plan = store.query(names=["m"], labels={"a": "b"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("element_at") and [r["value"] for r in store.query(labels={"a": "b"}).collect()] == [5.0]


def test_compaction_of_a_store(spark, make, tmp_path):
    store, now = SampleStore(spark, str(tmp_path / "s")), T0 + 8 * H
    store.write(make(*[("m", 60 * k, k, {"a": "b"}) for k in range(480)]))
    once = rollup.compact_store(store, now)
    assert once["5m"] == 24 and once["deleted raw"] == 120 and once["deleted 5m"] == 0
    left = sorted(map(str, store.samples().collect()))
    assert store.samples().where("resolution = ''").count() == 360 and store.samples().where("resolution = '5m'").count() == 24
    rollup.compact_store(store, now)
    assert sorted(map(str, store.samples().collect())) == left
    with pytest.raises(ValueError):
        rollup.compact_store(SampleStore(spark, str(tmp_path / "t"), upsert=False), now)


def test_maintenance_tries_again_and_tells(spark, tmp_path):
    slept = []
    store = SampleStore(spark, str(tmp_path / "s"), upsert=False)
    found = rollup.maintained(store, T0, (1.0, 2.0), slept.append)
    assert not found["healthy"] and found["attempts"] == 3 and slept == [1.0, 2.0] and "twice" in found["error"]
    assert rollup.maintained(SampleStore(spark, str(tmp_path / "u")), T0)["healthy"]


def test_series_are_kept_and_expire(spark, tmp_path):
    now = [T0]
    api = StoreApi(SampleStore(spark, str(tmp_path / "s")), clock=lambda: now[0])
    body = '{"metrics": [{"name": "a", "value": 1, "labels": {"x": "%d", "_i": "z"}}, {"name": "a", "value": 2, "labels": {"x": "1"}}]}'
    api.ingest(body % 1)
    now[0] += 20 * H
    api.ingest(body % 2)
    assert api.store.series().count() == 2 and api.expire() == 0
    now[0] += 24 * H
    assert api.expire() == 0 and api.store.series(now[0]).count() == 0
    now[0] += S
    assert api.expire() == 2 and api.store.series().count() == 0
    known = spark.createDataFrame([("a", [(f"k{k}", "v")]) for k in range(3)], "name string, series array<struct<key:string,value:string>>")
    assert ingest.cardinality_errors(ingest.from_json(spark.createDataFrame([(body % 7,)], "value string")), known, limit=3).count() == 2


@pytest.mark.parametrize("value, text", [(12345678.9, "12345678.9"), (0.00012, "0.00012"), (1e16, "10000000000000000"), (1.5e21, "1500000000000000000000"), (-2.5e-7, "-0.00000025"), (100.0, "100"), (-0.5, "-0.5"), (0.0, "0"), (1e-9, "0.000000001"), (123456789012.25, "123456789012.25"), (float("inf"), "+Inf"), (float("nan"), "NaN"), (None, None)])
def test_numbers_have_no_exponent(spark, value, text):
    got = spark.createDataFrame([(value,)], "v double").select(scalars.shortest(F.col("v"))).first()[0]
    assert got == text and (value is None or value != value or float(got) == value)


@pytest.mark.parametrize("seed", range(3))
def test_ties_in_any_order_of_the_input(spark, seed):
    rows = [({}, T0 + t * S, float(v)) for t, v in ((0, 1), (0, 4), (10, 2), (10, 7), (25, 3), (25, 30), (40, 9), (90, 50), (90, 8))]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "labels map<string,string>, ts timestamp, value double").repartition(3)
    for f in (ranges.rate, ranges.rate_by_series):
        assert sorted(round(r["value"] * 20, 6) for r in f(df, 20_000_000).collect()) == [0.0, 0.0, 2.0, 26.0, 41.0]
    assert sorted(r["value"] for r in ranges.last_over_time(df, 20_000_000).collect()) == [4.0, 4.0, 7.0, 7.0, 9.0, 30.0, 30.0, 50.0, 50.0]


def test_plans_need_no_window_on_the_series_alone(spark, make):
    df = make(("m", 0, 1, {})).select("labels", "ts", "value")
    for f in (ranges.COMPATIBLE["increase"], ranges.EXTENDED["max_over_time"], ranges.EXTENDED["irate"], ranges.EXTENDED["delta"]):
        plan = f(df, 1_000_000)._jdf.queryExecution().optimizedPlan().toString()
        assert all("_block" in line or "min(_first" in line for line in plan.splitlines() if "Window [" in line)


def test_running_sums_and_gauges_across_pieces(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), k * 700 + rng.randrange(500), rng.choice(["inc", "add", "sub", "set", "dec", "add"]) if k > 20 else "inc", float(rng.randrange(9))) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, op string, value double")
    assert df.select(F.count_distinct(running.pieces(df, ["t"]))).first()[0] > 30
    state, expected, total = {}, [], {}
    for k, t, op, v in sorted(rows, key=lambda r: r[1]):
        g = state.get(k, 0.0)
        state[k] = {"inc": g + 1, "dec": g - 1, "add": g + v, "sub": g - v, "set": v}[op]
        total[k] = total.get(k, 0.0) + v
        expected.append((k, t, state[k], total[k]))
    gauges = {(r["k"], r["t"]): r["gauge"] for r in instruments.gauge(df, ["k"], ["t"]).collect()}
    totals = {(r["k"], r["t"]): r["total"] for r in instruments.counter(df, ["k"], ["t"]).collect()}
    assert all(gauges[k, t] == g and totals[k, t] == s for k, t, g, s in expected) and len(gauges) == len(totals) == 200
    places = running.placed(df, ["k"], ["t"]).collect()
    for key in "ab":
        mine = sorted((r["t"], r["_i"], r["_n"]) for r in places if r["k"] == key)
        assert [i for _, i, _ in mine] == list(range(1, len(mine) + 1)) and {n for *_, n in mine} == {len(mine)}


def test_too_wide_an_export_is_refused(make, monkeypatch, tmp_path):
    monkeypatch.setattr(exchange, "MAX_KEYS", 2)
    monkeypatch.setattr(exchange, "MAX_DOCUMENT", 1)
    df = make(("m", 0, 1, {"a": "1", "b": "2"}), ("m", 1, 1, {"c": "3"}))
    with pytest.raises(ValueError):
        exchange.export_csv(df, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        exchange.json_document(df, T0, T0 + H, T0)


def test_late_samples_have_a_table_of_their_own(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"metrics": [{"name": "a", "value": %d, "timestamp": "%s"}]}' % (k, (T0 - k * H).isoformat()) for k in range(10)]
    (tmp_path / "in" / "b.json").write_text("\n".join(lines) + "\n")
    store = SampleStore(spark, str(tmp_path / "s"))
    flow.into_store_and_late(flow.valid_samples(flow.bodies(spark, str(tmp_path / "in"))), store, str(tmp_path / "late"), str(tmp_path / "cp"), lambda: T0).awaitTermination(120)
    assert store.samples().count() == 7 and spark.read.parquet(str(tmp_path / "late")).count() == 3
    assert spark.read.parquet(str(tmp_path / "late")).columns[: len(model.SAMPLES.fieldNames())] == model.SAMPLES.fieldNames()
