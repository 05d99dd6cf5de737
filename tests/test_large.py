"""Registered queries that read more than a million samples, against their SQL."""

import pytest
from pyspark.sql import functions as F
from test_ties import agrees


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A folder with the smallest events of six days so often that they are more than a million, under numbers of their own."""
    folder = str(tmp_path_factory.mktemp("large"))
    one = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("ts between timestamp_ntz'2024-01-03' and timestamp_ntz'2024-01-09'")
    copies = one.crossJoin(spark.range(1_000_000 // one.count() + 1)).withColumn("event_id", F.col("event_id") + F.col("id") * 1_000_000).drop("id")
    copies.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_prometheus_range(spark, large):
    assert agrees(spark, large, "prometheus_range")


def test_result_count(spark, large):
    assert agrees(spark, large, "result_count")
