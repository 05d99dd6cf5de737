import json
from datetime import timedelta

from moments import T0
from pyspark.sql import functions as F

from tidemark.operators import rollup
from tidemark.sources.store import SampleStore
from tidemark.streaming import flow


def bodies(folder, *groups):
    folder.mkdir(exist_ok=True)
    for k, metrics in enumerate(groups):
        (folder / f"{k}.json").write_text(json.dumps({"metrics": metrics}) + "\n")


def metric(name, seconds, value, **labels):
    return {"name": name, "type": "gauge", "value": value, "labels": labels, "timestamp": (T0 + timedelta(seconds=seconds)).isoformat()}


def test_ingest_stream_into_store(spark, tmp_path):
    bodies(tmp_path / "in", [metric("a", 0, 1, x="y"), metric("a", 60, 3, x="y")], [metric("", 0, 1), metric("b", 0, 1)], [metric("a", 0, 2, x="y")])
    store = SampleStore(spark, str(tmp_path / "store"))
    q = flow.into_store(flow.valid_samples(flow.bodies(spark, str(tmp_path / "in"), 1)), store, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r["name"] for r in store.samples().collect()) == ["a", "a"]  # the body with a bad sample is refused whole


def test_streamed_rollup_is_the_batch_rollup(spark, tmp_path):
    metrics = [metric("a", 30 * k, float(k), x="y") for k in range(100)]
    bodies(tmp_path / "in", metrics[:50], metrics[50:], [metric("a", 86_400, 1.0, x="y")])
    stream = flow.rolled_up(flow.valid_samples(flow.bodies(spark, str(tmp_path / "in"), 1)))
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["ts"], r["agg"]["sum"], r["agg"]["count"]) for r in spark.table("rolled").collect()}
    lines = spark.read.text(str(tmp_path / "in"))
    batch = rollup.five_minutes(flow.valid_samples(lines))
    closed = batch.where(F.col("ts") < F.lit(T0 + timedelta(hours=2)).cast("timestamp"))
    assert got == {(r["ts"], r["agg"]["sum"], r["agg"]["count"]) for r in closed.collect()} and len(got) == 10


def test_first_seen_series(spark, tmp_path):
    bodies(tmp_path / "in", [metric("a", 0, 1, x="y"), metric("a", 1, 1, x="y"), metric("a", 0, 1, x="z")], [metric("a", 60, 1, x="y")])
    seen = flow.first_seen_series(flow.valid_samples(flow.bodies(spark, str(tmp_path / "in"), 1)))
    q = seen.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["series"] for r in spark.table("seen").collect()) == ['{"x":"y"}', '{"x":"z"}']
