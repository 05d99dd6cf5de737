import math
import random
from datetime import timedelta

import pytest
from moments import T0
from pyspark.sql import functions as F

from tidemark import model
from tidemark.api import QueryApi
from tidemark.functions import ranges
from tidemark.plans.lower import Planner
from tidemark.plans.syntax import QueryError

S = timedelta(seconds=1)


def run(df, text, start=0, end=100, mode="compat", step=10, **more):
    rows = Planner(df, T0 + start * S, T0 + end * S, step * S, mode, **more).query(text).collect()
    return sorted((tuple(sorted(r["labels"].items())), round((r["ts"].timestamp() - T0.timestamp())), r["value"]) for r in rows)


def values(rows):
    return [(t, round(v, 9)) for _, t, v in rows]


CURVE = [("m", t, v, {}) for t, v in ((0, 0), (5, 5), (10, 12), (15, 3), (20, 30))]


@pytest.mark.parametrize("size, expected", [(5, [(5, 1.0), (10, 2.4), (15, 0.0), (20, 3.6)]), (10, [(10, 1.2), (15, 0.3), (20, 2.5)])])
def test_rate(make, size, expected):
    assert values(run(make(*CURVE), f"rate(m[{size}s])", 5 if size == 5 else 10, 20)) == [(t, v) for t, v in expected]


def test_rate_takes_an_old_baseline_and_increase_scales(make):
    df = make(*[("m", t, v, {}) for t, v in ((0, 1), (1, 2), (2, 3), (20, 4))])
    assert values(run(df, "rate(m[7s])", 7, 20)) == [(20, round(1 / 7, 9))]
    assert values(run(df, "increase(m[7s])", 7, 20)) == [(20, 1.0)]


def brute_rate(points, size):
    out = []
    for t, v in points:
        base = [p for p in points if p[0] < t - size]
        b = base[-1][1] if base else points[0][1] if points[0][0] == t - size else None
        if b is not None:
            out.append((t, max(0.0, (v - b) / size)))
    return out


def test_rate_against_brute_force(make):
    random.seed(3)
    rows, series = [], {}
    for k in range(4):
        points = sorted((t, float(random.randint(0, 50))) for t in random.sample(range(-60, 400), 60))
        series[k] = points
        rows += [("m", t, v, {"k": str(k)}) for t, v in points]
    df = make(*rows).select("labels", "ts", "value")
    for function in (ranges.rate, ranges.rate_by_series):
        for size in (7, 50, 300):
            got = function(df, size * 1_000_000).collect()
            found = sorted((r["labels"]["k"], round(r["ts"].timestamp() - T0.timestamp()), round(r["value"], 9)) for r in got)
            assert found == sorted((str(k), t, round(v, 9)) for k, p in series.items() for t, v in brute_rate(p, size))


def test_selector_matchers_and_ends(make):
    df = make(("m", 0, 1, {"a": "x"}), ("m", 50, 2, {"a": "y"}), ("m", 100, 3, {}), ("m", 101, 4, {"a": "x"}), ("n", 0, 5, {"a": "x"}), ("m", 7, 6, None))
    assert [v for _, _, v in run(df, "m")] == [6.0, 3.0, 1.0, 2.0] or sorted(v for _, _, v in run(df, "m")) == [1.0, 2.0, 3.0, 6.0]
    assert [v for _, _, v in run(df, 'm{a="x"}')] == [1.0]
    assert [v for _, _, v in run(df, 'm{a=""}')] == [3.0]  # missing equals empty, null labels never match
    assert [v for _, _, v in run(df, 'm{a="x", a="y"}')] == [2.0]  # the last counts
    with pytest.raises(QueryError):
        run(df, 'm{a!="x"}')
    assert sorted(v for _, _, v in run(df, 'm{a=~"x|y"}', mode="extended")) == [1.0, 2.0]
    assert sorted(v for _, _, v in run(df, 'm{a!="x"}', mode="extended")) == [2.0, 3.0, 6.0]


def test_groups_tell_missing_from_empty(make):
    df = make(("m", 0, 1, {"g": ""}), ("m", 0, 2, {"h": "z"}), ("m", 0, 4, {"g": "", "h": "z"}))
    assert run(df, "sum by (g) (m)") == [((), 0, 2.0), ((("g", ""),), 0, 5.0)]
    assert run(df, "sum without (h) (m)") == [((), 0, 2.0), ((("g", ""),), 0, 5.0)]
    assert run(df, "count(m)") == [((), 0, 3.0)]
    assert run(df, "avg(m)") == [((), 0, pytest.approx(7 / 3))]
    assert run(df, "min(m)")[0][2] == 1.0 and run(df, "max(m)")[0][2] == 4.0


def test_binary_needs_one_series_each_and_divides_by_zero_to_nan(make):
    df = make(("a", 0, 6, {"x": "1"}), ("a", 10, 7, {"x": "1"}), ("b", 0, 0, {}), ("b", 10, 2, {}), ("b", 20, 9, {}), ("c", 0, 1, {"x": "1"}), ("c", 0, 1, {"x": "2"}))
    got = run(df, "a / b")
    assert math.isnan(got[0][2]) and got[1][2] == 3.5 and got[0][0] == (("x", "1"),)
    assert math.isnan(run(df, "a % b")[0][2])
    assert [v for _, _, v in run(df, "a - b")] == [6.0, 5.0]
    for text in ("a + c", "a + nothing", "a > b", "a and b", "stddev(a)", "irate(a[5s])"):
        with pytest.raises(QueryError):
            run(df, text)


def test_numbers_are_grids(make):
    df = make(("a", 0, 6, {}), ("a", 15, 7, {}))
    assert values(run(df, "2 ^ 3", 0, 30)) == [(0, 8.0), (10, 8.0), (20, 8.0), (30, 8.0)]
    assert values(run(df, "a * 2", 0, 30)) == [(0, 12.0)]  # only at the grid's times
    assert values(run(df, "a * 2", 0, 30, "extended")) == [(0, 12.0), (15, 14.0)]
    assert values(run(df, "-7.5 % 2", 0, 0, "extended")) == [(0, -1.5)]


def test_budget(make):
    df = make(*[("test_metric", t, t, {"instance": "test"}) for t in range(150)])
    with pytest.raises(QueryError, match=r"query exceeded max samples limit: loaded 101, limit 100 \(reduce time range or increase MaxSamples\)"):
        run(df, "test_metric", 0, 200, max_samples=100)
    assert len(run(df, "test_metric", 0, 49, max_samples=1000)) == 50


def test_extended_operators(make):
    df = make(("a", 0, 1, {"x": "1"}), ("a", 0, 5, {"x": "2"}), ("b", 0, 10, {"x": "1"}), ("b", 0, 20, {"x": "3"}), ("c", 0, 2, {"x": "1", "y": "p"}), ("c", 0, 4, {"x": "1", "y": "q"}))
    x = lambda *v: tuple((("x", k),) for k in v)
    assert run(df, "a + b", mode="extended") == [((("x", "1"),), 0, 11.0)]
    assert [r[0] for r in run(df, "a and b", mode="extended")] == list(x("1"))
    assert [r[0] for r in run(df, "a unless b", mode="extended")] == list(x("2"))
    assert [r[0] for r in run(df, "a or b", mode="extended")] == list(x("1", "2", "3"))
    assert run(df, "a > 2", mode="extended") == [((("x", "2"),), 0, 5.0)]
    assert [v for _, _, v in run(df, "a > bool 2", mode="extended")] == [0.0, 1.0]
    assert [v for _, _, v in run(df, "c / on (x) group_left a", mode="extended")] == [2.0, 4.0]
    assert run(df, "topk(1, a)", mode="extended") == [((("x", "2"),), 0, 5.0)]
    assert run(df, "quantile(0.5, a)", mode="extended") == [((), 0, 3.0)]
    assert run(df, "stdvar(a)", mode="extended") == [((), 0, 4.0)]
    assert run(df, 'count_values("v", a)', mode="extended") == [((("v", "1"),), 0, 1.0), ((("v", "5"),), 0, 1.0)]
    with pytest.raises(Exception, match="group_left"):
        run(df, "c / on (x) a", mode="extended")


def test_extended_ranges(make):
    df = make(*[("m", t, v, {}) for t, v in ((0, 1), (10, 5), (20, 2), (30, 8))])
    assert values(run(df, "max_over_time(m[20s])", 20, 30, "extended")) == [(20, 5.0), (30, 8.0)]
    assert values(run(df, "irate(m[20s])", 10, 30, "extended")) == [(10, 0.4), (20, 0.2), (30, 0.6)]
    assert values(run(df, "reset_increase(m[31s])", 30, 30, "extended")) == [(30, 12.0)]
    assert values(run(df, "delta(m[15s])", 10, 30, "extended")) == [(10, 4.0), (20, -3.0), (30, 6.0)]
    assert values(run(df, "m offset 10s", 20, 30, "extended")) == [(20, 5.0), (30, 2.0)]
    assert values(run(df, "count_over_time(m[30s:20s])", 30, 30, "extended")) == [(30, 2.0)]


def test_names_and_times_reach_the_scan(spark, make, tmp_path):
    make(("m", 0, 1, {"a": "x"})).write.parquet(str(tmp_path / "s"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    df = Planner(spark.read.parquet(str(tmp_path / "s")), T0, T0 + S, S).query("sum by (a) (m)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,m)" in plan and "GreaterThanOrEqual(ts" in plan and "type" not in plan.split("ReadSchema")[-1]


@pytest.fixture
def million(spark):
    """The query interface as it is by default, over one sample more than a million, at two times."""
    n = F.col("id")
    rows = spark.range(1_000_001).select(F.lit("m").alias("name"), n.cast("double").alias("value"), F.create_map(F.lit("x"), F.lit("1")).alias("labels"), F.timestamp_seconds(F.lit(int(T0.timestamp())) + n % 2).alias("ts"))
    return QueryApi(model.samples(rows))


def test_execute_reads_more_than_a_million_samples(million):
    rows = million.execute("count by (x) (m)", T0, T0 + 4 * S).collect()
    assert [(r["metric"], [p["v"] for p in r["values"]]) for r in rows] == [({"x": "1"}, ["500001.000000", "500000.000000"])]


def test_query_range_reads_more_than_a_million_samples(million):
    rows = million.query_range("sum by (x) (m)", str(T0.timestamp()), (T0 + S).isoformat(), "1s").collect()
    assert [[p["v"] for p in r["values"]] for r in rows] == [["250000500000.000000", "250000000000.000000"]]


def test_points_of_more_than_a_million_samples_are_counted(million):
    assert million.total_points("m", T0, T0 + S) == 1_000_001
