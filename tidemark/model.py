"""The sample: one row for each value of a labelled series at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes and numbers that ingest allows.
MAX_NAME, MAX_LABELS, MAX_KEY, MAX_VALUE = 256, 20, 256, 1024
#: Kinds of metrics.
KINDS = ("counter", "gauge", "histogram")
#: Resolutions of stored samples: raw, and two of rollups.
RAW, FIVE_MINUTES, ONE_HOUR = "", "5m", "1h"
#: Internal label that tells samples of one series and time apart, such as the number of an event. It is a part of a sample's key, not of its series.
SAMPLE = "__sample__"

AGGREGATE = T.StructType([T.StructField("sum", T.DoubleType()), T.StructField("count", T.LongType()), T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())])
SAMPLES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("agg", AGGREGATE),
    ]
)


def samples(df: DataFrame) -> DataFrame:
    """``df`` in the sample's columns: what is missing is filled, and times without a zone are taken as UTC."""
    has = set(df.columns)
    columns = []
    for field in SAMPLES.fields:
        if field.name in has:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        elif field.name == "resolution":
            columns.append(F.lit(RAW).alias("resolution"))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def series_key(labels: str | Column = "labels") -> Column:
    """The labels in order as an array, which can be grouped by, joined on and sorted, as a map can't; null labels are no labels."""
    given = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(F.sort_array(F.map_entries(given)), F.map_entries(F.create_map().cast("map<string,string>")))


def label(key: str, labels: str | Column = "labels") -> Column:
    """A label's value, null where the series has no such label."""
    given = F.col(labels) if isinstance(labels, str) else labels
    return F.try_element_at(given, F.lit(key))


def user_labels(labels: str | Column = "labels") -> Column:
    """The labels without internal ones, whose key begins with ``_``; an empty key stays."""
    given = F.col(labels) if isinstance(labels, str) else labels
    return F.map_filter(given, lambda k, v: ~k.startswith("_"))


def series_labels(labels: str | Column = "labels") -> Column:
    """The labels of the series, without :data:`SAMPLE`."""
    given = F.col(labels) if isinstance(labels, str) else labels
    return F.map_filter(given, lambda k, v: k != SAMPLE)


def label_equals(key: str, value: str) -> Column:
    """Equality of a label: null labels never match, and a label that is missing equals the empty string."""
    return F.col("labels").isNotNull() & (F.coalesce(label(key), F.lit("")) == F.lit(value))


def in_range(start, end) -> Column:
    """Both ends belong to a time range."""
    return F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def micros(ts: str | Column = "ts") -> Column:
    return F.unix_micros(ts)
