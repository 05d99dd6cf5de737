"""The syntax tree to one lazy DataFrame of ``labels``, ``ts`` and ``value``.

``mode="compat"`` evaluates what the compatible language evaluates, on the samples' own times; what that language reads but can't evaluate is an
error. ``mode="extended"`` adds the other operators with their public PromQL meaning, and takes a number as a scalar.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import ranges, scalars
from tidemark.plans import syntax
from tidemark.plans.syntax import QueryError

ARITHMETIC, COMPARISONS, SETS = ("+", "-", "*", "/", "%", "^"), syntax.LEVELS[3], ("and", "or", "unless")
#: Most steps of a number's grid.
MAX_STEPS = 11_000


@dataclass
class Vector:
    """A result: its rows, whether it can only be one series, and whether times in a series are known to differ."""

    df: DataFrame
    single: bool = False
    distinct: bool = False
    scalar: float | None = None


def _text(at: datetime) -> str:
    return at.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


def _moment(at: datetime) -> Column:
    return F.lit(_text(at)).cast("timestamp")


class Planner:
    """Lowers queries over one DataFrame of samples.

    ``resolution`` is the stored resolution that selectors read, raw by default, or ``all``. ``max_samples`` bounds the raw samples that all selectors of
    a query read together; checking it counts them first. Reading one series where the language wants one is checked by
    a small job, unless the query's form already tells.
    """

    def __init__(self, samples: DataFrame, start: datetime, end: datetime, step: timedelta = timedelta(seconds=15), mode: str = "compat", resolution: str = model.RAW, max_samples: int | None = None):
        if mode not in ("compat", "extended"):
            raise ValueError("mode is compat or extended")
        if step <= timedelta(0):
            raise QueryError("the step is above zero")
        self.samples, self.start, self.end, self.step = samples, start, end, step
        self.extended, self.resolution, self.max_samples, self._loaded = mode == "extended", resolution, max_samples, 0
        self.spark: SparkSession = samples.sparkSession

    def query(self, text: str) -> DataFrame:
        """The result of a query: labels, ts, value."""
        self._loaded = 0
        return self.lower(syntax.parse(text, self.extended), self.start, self.end).df.select("labels", "ts", "value")

    def lower(self, node, start: datetime, end: datetime) -> Vector:
        if isinstance(node, syntax.Number):
            return self.number(node.value, start, end)
        if isinstance(node, syntax.Selector):
            return Vector(self.selector(node, start, end))
        if isinstance(node, syntax.Range):
            return Vector(self.selector(node.selector, start - timedelta(microseconds=node.micros), end))
        if isinstance(node, syntax.Subquery):
            return Vector(self.subquery(node, start, end))
        if isinstance(node, syntax.Call):
            return Vector(self.call(node, start, end))
        if isinstance(node, syntax.Aggregate):
            return self.aggregate(node, start, end)
        if isinstance(node, syntax.Unary):
            inner = self.lower(node.expr, start, end)
            if node.op == "+":
                return inner
            return Vector(inner.df.withColumn("value", -F.col("value")), inner.single, inner.distinct, None if inner.scalar is None else -inner.scalar)
        if isinstance(node, syntax.Binary):
            return self.binary(node, self.lower(node.left, start, end), self.lower(node.right, start, end))
        raise QueryError(f"can't evaluate {node!r}")

    # Leaves

    def number(self, value: float, start: datetime, end: datetime) -> Vector:
        """One series without labels: the number at start, start + step, ... up to the end."""
        steps = (end - start) // self.step + 1
        if steps > MAX_STEPS:
            raise QueryError(f"a number over {steps} steps; at most {MAX_STEPS}")
        micros = self.step // timedelta(microseconds=1)
        grid = self.spark.range(max(steps, 0)).select(F.create_map().cast("map<string,string>").alias("labels"), F.timestamp_micros(F.unix_micros(_moment(start)) + F.col("id") * micros).alias("ts"), F.lit(value).cast("double").alias("value"))
        return Vector(grid, True, True, value)

    def selector(self, node: syntax.Selector, start: datetime, end: datetime) -> DataFrame:
        """All samples of a name in the range whose labels match. The last of several matchers on one label counts in compat mode."""
        shift = timedelta(microseconds=node.offset)
        rows = self.samples.where(F.col("ts").between(_moment(start - shift), _moment(end - shift)))
        if node.name:
            rows = rows.where(F.col("name") == node.name)
        if self.resolution != "all" and "resolution" in self.samples.columns:
            rows = rows.where(F.col("resolution") == self.resolution)
        matchers = list(node.matchers) if self.extended else list({m.label: m for m in node.matchers}.values())
        for m in matchers:
            rows = rows.where(self.matcher(m))
        if self.max_samples is not None:
            self._loaded += rows.limit(self.max_samples - self._loaded + 1).count()
            if self._loaded > self.max_samples:
                raise QueryError(f"query exceeded max samples limit: loaded {self._loaded}, limit {self.max_samples} (reduce time range or increase MaxSamples)")
        ts = F.col("ts") if not node.offset else F.timestamp_micros(F.unix_micros("ts") + F.lit(node.offset))
        return rows.select(F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"), ts.alias("ts"), F.col("value").cast("double").alias("value"))

    def matcher(self, m: syntax.Matcher) -> Column:
        if m.op == "=":
            return model.label_equals(m.label, m.value)
        if not self.extended:
            raise QueryError(f"the matcher {m.op} needs the extended mode")
        given = F.coalesce(model.label(m.label), F.lit(""))
        if m.op == "!=":
            return given != m.value
        found = given.rlike(f"^(?:{m.value})$")
        return found if m.op == "=~" else ~found

    def subquery(self, node: syntax.Subquery, start: datetime, end: datetime) -> DataFrame:
        """The points of an expression over the range; with a step, the last of each step's points."""
        shift = timedelta(microseconds=node.offset)
        inner = self.lower(node.expr, start - shift - timedelta(microseconds=node.micros), end - shift).df
        if node.offset:
            inner = inner.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.lit(node.offset)))
        if not node.step:
            return inner
        bucket = F.expr(f"unix_micros(ts) div {node.step}L")
        last = inner.withColumn("_key", model.series_key()).groupBy("_key", bucket.alias("_bucket")).agg(F.max(F.struct("ts", "value")).alias("p"))
        return last.select(F.map_from_entries("_key").alias("labels"), "p.ts", "p.value")

    # Functions

    def call(self, node: syntax.Call, start: datetime, end: datetime) -> DataFrame:
        table = {**ranges.COMPATIBLE, **(ranges.EXTENDED if self.extended else {})}
        if node.name not in table:
            raise QueryError(f"unknown function: {node.name}")
        if len(node.args) != 1:
            raise QueryError(f"{node.name} takes one argument")
        argument = node.args[0]
        if not isinstance(argument, (syntax.Range, syntax.Subquery)):
            raise QueryError(f"{node.name} takes a range selector")
        return table[node.name](self.lower(argument, start, end).df, argument.micros).where(F.col("ts") >= _moment(start)) if self.extended else table[node.name](self.lower(argument, start, end).df, argument.micros)

    # Aggregations

    def aggregate(self, node: syntax.Aggregate, start: datetime, end: datetime) -> Vector:
        """Values of a group at exactly equal times. Groups are told by the labels that a series has: a missing one differs from an empty one."""
        df = self.lower(node.expr, start, end).df
        simple = {"sum": F.sum("value"), "avg": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count(F.lit(1)).cast("double")}
        if node.op not in simple and not self.extended:
            raise QueryError(f"{node.op} needs the extended mode")
        if node.without:
            kept = F.map_filter("labels", lambda k, v: ~k.isin(list(node.labels))) if node.labels else F.col("labels")
            df, keys = df.withColumn("_g", model.series_key(kept)), ["_g"]
            labels = F.map_from_entries("_g")
        else:
            keys = [f"_g{k}" for k in range(len(node.labels))]
            df = df.withColumns({k: model.label(name) for k, name in zip(keys, node.labels)}) if keys else df
            pairs = [x for k, name in zip(keys, node.labels) for x in (F.lit(name), F.col(k))]
            labels = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        single = not node.without and not keys
        if node.op in ("topk", "bottomk"):
            order = F.col("value").desc() if node.op == "topk" else F.col("value").asc()
            place = F.row_number().over(W.partitionBy(*keys, "ts").orderBy(F.isnan("value"), order, model.series_key()))
            return Vector(df.withColumn("_place", place).where(F.col("_place") <= int(self._constant(node, "topk"))).select("labels", "ts", "value"))
        if node.op == "count_values":
            if not isinstance(node.param, str):
                raise QueryError("count_values takes a label's name")
            counted = df.groupBy(*keys, "ts", F.col("value").alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("value"))
            named = F.map_concat(labels, F.create_map(F.lit(node.param), scalars.shortest(F.col("_v"))))
            return Vector(counted.select(named.alias("labels"), "ts", "value"))
        more = {"stddev": F.stddev_pop("value"), "stdvar": F.var_pop("value")}
        if node.op == "quantile":
            p = self._constant(node, "quantile")
            found = F.percentile("value", F.lit(p)) if 0 <= p <= 1 else F.max(F.lit(float("inf" if p > 1 else "-inf")))
        else:
            found = {**simple, **more}[node.op]
        grouped = df.groupBy(*keys, "ts").agg(found.alias("value"))
        return Vector(grouped.select(labels.alias("labels"), "ts", "value"), single, True)

    def _constant(self, node: syntax.Aggregate, what: str) -> float:
        value, sign = node.param, 1
        while isinstance(value, syntax.Unary):
            sign, value = (-sign if value.op == "-" else sign), value.expr
        if not isinstance(value, syntax.Number):
            raise QueryError(f"{what} takes a number")
        return sign * value.value

    # Binary operators

    def binary(self, node: syntax.Binary, left: Vector, right: Vector) -> Vector:
        if node.op not in ARITHMETIC and not self.extended:
            raise QueryError(f"{node.op} needs the extended mode")
        if self.extended:
            if node.op in SETS:
                return self.set_operation(node, left, right)
            if left.scalar is not None or right.scalar is not None:
                return self.with_scalar(node, left, right)
            return self.matched(node, left, right)
        if not (self._one(left) and self._one(right)):
            raise QueryError("vector-to-vector operations not yet implemented")
        other = right.df if right.distinct else right.df.groupBy("ts").agg(F.min("value").alias("value"))  # of several values at one time, the least
        joined = left.df.join(other.select("ts", F.col("value").alias("_right")), "ts")
        return Vector(joined.select("labels", "ts", scalars.arithmetic(node.op, F.col("value"), F.col("_right")).alias("value")), True, left.distinct)

    def _one(self, v: Vector) -> bool:
        """Whether the result is exactly one series."""
        return v.single or v.df.select(model.series_key().alias("k")).distinct().limit(2).count() == 1

    def _value(self, node: syntax.Binary, left: Column, right: Column) -> tuple[Column, Column | None]:
        """The value, and the condition to keep the row."""
        if node.op in ARITHMETIC:
            return scalars.arithmetic(node.op, left, right), None
        found = scalars.compared(node.op, left, right)
        return (found.cast("double"), None) if node.as_bool else (left, found)

    def with_scalar(self, node: syntax.Binary, left: Vector, right: Vector) -> Vector:
        """A number beside a vector or another number."""
        rows = right if left.scalar is not None and right.scalar is None else left
        a = F.lit(left.scalar) if left.scalar is not None else F.col("value")
        b = F.lit(right.scalar) if right.scalar is not None else F.col("value")
        value, keep = self._value(node, a, b)
        if left.scalar is not None and right.scalar is not None and keep is not None:
            raise QueryError("comparing two numbers takes bool")
        if keep is not None:  # a comparison keeps the vector's own value
            value = F.col("value")
        df = rows.df.where(keep) if keep is not None else rows.df
        scalar = None
        if left.scalar is not None and right.scalar is not None:
            scalar = self.spark.range(1).select(value.alias("v")).first()[0]
        return Vector(df.withColumn("value", value), rows.single, rows.distinct, scalar)

    def _match_key(self, m: syntax.Matching, labels: str = "labels") -> Column:
        if not m.given:
            return model.series_key(labels)
        chosen = list(m.labels)
        return model.series_key(F.map_filter(labels, (lambda k, v: k.isin(chosen)) if m.on else (lambda k, v: ~k.isin(chosen))))

    def matched(self, node: syntax.Binary, left: Vector, right: Vector) -> Vector:
        """Vector matching at equal times: one to one, or many to one by ``group_left`` and ``group_right``."""
        m = node.matching
        a = left.df.withColumn("_key", self._match_key(m))
        b = right.df.select(F.col("labels").alias("_labels"), "ts", F.col("value").alias("_right"), self._match_key(m, "labels").alias("_key"))
        # Two series of the "one" side that match alike are an error, found while the query runs.
        only = W.partitionBy("_key", "ts")
        if m.many != "right":
            b = b.withColumn("_n", F.count(F.lit(1)).over(only)).where(F.coalesce(F.assert_true(F.col("_n") == 1, F.lit("many-to-many matching: the right side has several series for a match")).cast("boolean"), F.lit(True)))
        if m.many != "left":
            a = a.withColumn("_m", F.count(F.lit(1)).over(only)).where(F.coalesce(F.assert_true(F.col("_m") == 1, F.lit("many-to-one matching takes group_left or group_right")).cast("boolean"), F.lit(True)))
        value, keep = self._value(node, F.col("value"), F.col("_right"))
        joined = a.join(b, ["_key", "ts"])
        joined = joined.where(keep) if keep is not None else joined
        many, one = ("_labels", "labels") if m.many == "right" else ("labels", "_labels")
        if m.many:
            out = F.map_filter(many, lambda k, v: ~k.isin(list(m.include))) if m.include else F.col(many)
            if m.include:
                out = F.map_concat(out, F.map_filter(one, lambda k, v: k.isin(list(m.include))))
        elif m.on:
            chosen = list(m.labels)
            out = F.map_filter("labels", lambda k, v: k.isin(chosen))
        elif m.given:
            chosen = list(m.labels)
            out = F.map_filter("labels", lambda k, v: ~k.isin(chosen))
        else:
            out = F.col("labels")
        return Vector(joined.select(out.alias("labels"), "ts", value.alias("value")))

    def set_operation(self, node: syntax.Binary, left: Vector, right: Vector) -> Vector:
        """``and``, ``unless`` and ``or`` of points that match by labels and time."""
        a = left.df.withColumn("_key", self._match_key(node.matching))
        b = right.df.withColumn("_key", self._match_key(node.matching))
        there = ["_key", "ts"]
        if node.op == "and":
            out = a.join(b.select(*there), there, "left_semi")
        elif node.op == "unless":
            out = a.join(b.select(*there), there, "left_anti")
        else:
            out = a.unionByName(b.join(a.select(*there), there, "left_anti"))
        return Vector(out.select("labels", "ts", "value"))
