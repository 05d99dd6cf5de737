"""Connected components, in memory for what one task holds and over DataFrames for the whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared

#: A guard only; the rounds that are needed grow with the logarithm of the longest path.
ROUNDS = 60


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links (i, j)."""
    parent = np.arange(n)
    while i.size:
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return parent


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that has a link.

    Alternates large-star and small-star steps until the links are stars: a node's larger neighbours, then its smaller ones, are linked
    to the smallest node next to it. Every step groups with partial aggregates and joins on nodes, so that neither a large
    component nor a node of many links is held by one task; the links of a round are written to the shared folder.
    """
    links = edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u > v").distinct()
    links, before = shared.cut(links), None
    for _ in range(ROUNDS):
        state = links.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
        if state == before or not state[0]:
            break
        before = state
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).union(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = shared.cut(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
