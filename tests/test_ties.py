"""Queries over events of which several have one type and time, against their SQL."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__


@pytest.fixture(scope="module")
def ties(spark, tmp_path_factory):
    """A folder with the smallest events three times, under numbers of their own."""
    folder = str(tmp_path_factory.mktemp("ties"))
    one = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copies = one.crossJoin(spark.range(3)).withColumn("event_id", F.col("event_id") + F.col("id") * 1_000_000).drop("id")
    copies.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def agrees(spark, folder, name):
    got = __spark_entry__.queries()[name](spark, folder)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        found = db.execute(__spark_entry__.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        expected = Counter(tuple(map(str, r)) for r in found.fetchall())
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t == "timestamp" else F.col(c) for c, t in got.select(columns).dtypes]
    rows = Counter(tuple(str(v)[:19] if isinstance(v, str) and v.endswith(".000000") else str(v) for v in r) for r in got.select(times).collect())
    return rows == expected and sum(rows.values()) > 0


@pytest.mark.parametrize("name", ["store_compaction", "store_delete", "store_upsert", "streamed_late", "streamed_rollup"])
def test_queries(spark, ties, name):
    assert agrees(spark, ties, name)
