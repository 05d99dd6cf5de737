"""What instruments compute before they send: counters, gauges, histograms, request metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.scalars import normal_path
from tidemark.operators import running

#: Upper bounds of a histogram's buckets, in seconds.
BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def label_pairs(*pairs: str) -> Column:
    """Labels from a flat list of keys and values; of a list of odd length, none at all."""
    if len(pairs) % 2 or not pairs:
        return F.lit(None).cast("map<string,string>")
    return F.map_from_arrays(F.array(*map(F.lit, pairs[::2])), F.array(*map(F.lit, pairs[1::2])))


def counter(steps: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Each step with the running total of its series. Negative steps are ignored. A long series is added up by pieces of time."""
    return running.placed(steps.where(F.col(value) >= 0), keys, order, {"total": F.col(value)}).select(*(c for c in steps.columns if c != "total"), "total")


def gauge(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each event with the gauge after it: ``op`` is set, add, sub, inc or dec, and ``value`` its operand.

    A long series is cut into pieces of time. What a piece hands on is the sum since its last set, added to what came before it if it has none.
    """
    op = F.col("op")
    change = F.when(op == "add", F.col("value")).when(op == "sub", -F.col("value")).when(op == "inc", 1.0).when(op == "dec", -1.0).when(op == "set", F.col("value"))
    cut = events.withColumns({"_piece": running.pieces(events, order), "_change": change})
    inside = running.along(keys, order)
    cut = cut.withColumn("_set", F.sum((op == "set").cast("int")).over(inside))
    since = W.partitionBy(*keys, "_piece", "_set").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = cut.withColumn("_since", F.sum("_change").over(since))
    ends = cut.groupBy(*keys, "_piece").agg(F.max("_set").alias("_sets"), F.max_by("_since", F.struct("_set", *order)).alias("_tail"))
    row = W.partitionBy(*keys).orderBy("_piece")
    ends = ends.withColumn("_run", F.sum((F.col("_sets") > 0).cast("int")).over(row))
    ends = ends.withColumn("_end", F.sum("_tail").over(W.partitionBy(*keys, "_run").orderBy("_piece")))
    ends = ends.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_piece").alias("_of"), F.coalesce(F.lag("_end").over(row), F.lit(0.0)).alias("_carry"))
    met = cut.join(ends, [*(F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)), F.col("_piece") == F.col("_of")])
    return met.withColumn("gauge", F.col("_since") + F.when(F.col("_set") == 0, F.col("_carry")).otherwise(0.0)).select(*events.columns, "gauge")


def bound_text(bound: float) -> str:
    """A bound as a label. The greatest is written as if it had no end, though greater values are not counted in it."""
    return "+Inf" if bound == BOUNDS[-1] else f"{bound:.3f}".rstrip("0").rstrip(".")


def histogram(values: DataFrame, keys: list[str], value: str = "value", true_infinity: bool = False) -> DataFrame:
    """Per series: the number of values up to each bound, and the ``sum`` and ``count`` of all, as rows of ``part`` and ``le``.

    All bounds are counted in one aggregation, and a row for each is made after it. ``true_infinity`` labels the last bound 10 and adds a bucket of all.
    """
    counts = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).cast("double").alias(f"_b{k}") for k, b in enumerate(BOUNDS)]
    grouped = values.groupBy(*keys).agg(*counts, F.sum(value).alias("_sum"), F.count(F.lit(1)).cast("double").alias("_count"))

    def row(part: str, le: str | None, v: str) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(le).cast("string").alias("le"), F.col(v).alias("value"))

    texts = [("10" if true_infinity and b == BOUNDS[-1] else bound_text(b), f"_b{k}") for k, b in enumerate(BOUNDS)]
    rows = [row("bucket", le, c) for le, c in texts] + ([row("bucket", "+Inf", "_count")] if true_infinity else []) + [row("sum", None, "_sum"), row("count", None, "_count")]
    return grouped.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def flushed(values: DataFrame, name: str, flush: str = "15 seconds", true_infinity: bool = False) -> DataFrame:
    """Histogram samples of every flush interval by itself: values are counted anew in each. Needs ``labels``, ``ts``, ``value``."""
    keyed = values.select(model.series_key().alias("_key"), F.window("ts", flush)["end"].alias("ts"), "value")
    rows = histogram(keyed, ["_key", "ts"], true_infinity=true_infinity)
    own = F.map_from_entries("_key")
    labels = F.when(F.col("part") == "bucket", F.map_concat(own, F.create_map(F.lit("le"), F.coalesce("le", F.lit(""))))).otherwise(own)
    return model.samples(rows.select(F.concat(F.lit(f"{name}_"), F.col("part")).alias("name"), F.lit("histogram").alias("type"), "value", labels.alias("labels"), "ts"))


def stamped(samples: DataFrame, service: str) -> DataFrame:
    """Samples with the label ``service``, in place of one they have."""
    rest = F.map_filter(F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda k, v: k != "service")
    return samples.withColumn("labels", F.map_concat(rest, F.create_map(F.lit("service"), F.lit(service))))


def request_metrics(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of an access log (``ts``, ``method``, ``path``, ``status``, ``seconds``): requests so far, and duration buckets, by method, normal path and status."""
    keys = ["method", "path", "status"]
    clean = log.withColumns({"path": normal_path(F.col("path")), "value": F.lit(1.0)})
    return counter(clean, keys, ["ts"]), histogram(clean.withColumn("value", F.col("seconds")), keys)
