"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import ranks, shared

#: Parts into which a leaf's rows are dealt to meet the leaf's budget.
SALTS = 64

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _weight(level: str, weights: dict[str, float], default: float) -> Column:
    if not weights:
        return F.lit(float(default))
    table = F.create_map(*chain.from_iterable((F.lit(f"={k}"), F.lit(float(v))) for k, v in weights.items()))
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(float(default)))


def _filled(nodes: DataFrame, parents: list[str], budget: Column, out: str) -> DataFrame:
    """Shares ``budget`` among the nodes of each parent by ``_weight``; no node gets more than its ``_cap``.

    What a full node cannot take goes to its siblings in proportion to their weights. A node is full if the level (budget left over
    weight left) at its place in the order of cap over weight reaches that ratio; then all before it are full too.
    """
    ratio = F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")).otherwise(F.lit(float("inf")))
    siblings = W.partitionBy(*parents)
    order = siblings.orderBy("_ratio", "_node")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    full = (F.col("_weight") > 0) & (F.col("_ratio") * F.col("_left") <= F.col("_budget") - F.col("_before"))
    return (
        nodes.withColumns({"_ratio": ratio, "_budget": budget})
        .withColumns({"_before": before, "_left": left})
        .withColumn("_full", full)
        .withColumns({"_spent": F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(siblings), "_open": F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(siblings)})
        .withColumn(out, F.when(F.col("_full"), F.col("_cap").cast("double")).when(F.col("_weight") <= 0, F.lit(0.0)).otherwise(F.col("_weight") * (F.col("_budget") - F.col("_spent")) / F.col("_open")))
        .drop("_ratio", "_budget", "_before", "_left", "_full", "_spent", "_open")
    )


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], share: float, epochs: int, default: float = 1.0) -> DataFrame:
    """Adds ``budget`` (whole tokens) to the leaves, which have the levels' keys and ``tokens``.

    The root gets ``share`` of all tokens there are. From the root down, each node shares its budget among its children by
    weight; a child can take ``epochs`` times the tokens of the leaves below it without a weight of 0 on their path, and what it cannot take goes to its siblings. A node never gets more
    than its children can take together, so a shortage leaves for the parent's siblings only when all siblings are full.
    """
    able = F.lit(True)
    for level in levels:
        able = able & (_weight(level, weights.get(level, {}), default) > 0)
    tree = leaves.withColumn("_cap0", F.when(able, F.col("tokens") * epochs).otherwise(0).cast("bigint"))
    total = W.partitionBy()
    tree = tree.withColumn("_share0", F.floor(F.sum("tokens").over(total) * F.lit(float(share))).cast("double"))
    for depth, level in enumerate(levels):
        parents, path = levels[:depth], levels[: depth + 1]
        nodes = tree.groupBy(*path).agg(F.sum("_cap0").alias("_cap"), F.max(f"_share{depth}").alias("_given"))
        nodes = nodes.withColumns({"_weight": _weight(level, weights.get(level, {}), default), "_node": F.col(level)})
        nodes = _filled(nodes, parents, F.col("_given"), f"_share{depth + 1}")
        tree = tree.join(nodes.select(*path, f"_share{depth + 1}"), path)
    return tree.withColumn("budget", F.floor(F.col(f"_share{len(levels)}") + F.lit(1e-6)).cast("bigint")).select(*levels, "tokens", "budget")


def mixed(rows: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], share: float, epochs: int = 1, seed: int = 29, ident: str = "doc_id", tokens: Column | None = None, ties: tuple[str, ...] = (), default: float = 1.0) -> DataFrame:
    """Every row with ``copies``, the number of epochs of its leaf that take it, and the leaf's ``leaf_tokens`` and ``leaf_budget``.

    ``levels`` name the tree from the root's children to the leaves, as columns; ``weights`` give a level's values their weights,
    others weigh ``default``. A null value is a node of its own. A leaf of T tokens and budget B takes B div T whole epochs, and of one more the
    rows that begin within the B mod T tokens that are left, in the order of a hash seeded by that epoch. A row without words
    is taken with the epoch it falls in. ``tokens`` counts a row's tokens (the words of ``text`` by default); ``ties`` order rows of equal
    ``ident``, and rows equal in these too are interchangeable. An empty table gives an empty table. Columns of the input stay, but
    those of the results' names are replaced. All columns go through one shuffle: give only those that are wanted.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    own = rows.columns
    slim = (
        rows.select(F.struct(*own).alias("_row"), F.col(ident).alias("_ident"), *(F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)), (word_count() if tokens is None else F.coalesce(tokens, F.lit(0))).cast("bigint").alias("tokens"), *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True)))
        .withColumn("_leaf", F.concat_ws("\u001f", *names))
    )
    slim = shared.cut(slim)  # the rows' words are counted once; the steps below read what is written here
    leaves = slim.groupBy("_leaf", *names).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(leaves.drop("_leaf"), names, {n: weights.get(k, {}) for n, k in zip(names, levels, strict=True)}, share, epochs, default)
    plan = plan.select(
        F.concat_ws("\u001f", *names).alias("_leaf"),
        F.col("tokens").alias("leaf_tokens"),
        F.col("budget").alias("leaf_budget"),
        F.expr("if(tokens > 0, budget div tokens, 0)").alias("_whole"),
        F.expr("if(tokens > 0, budget % tokens, 0)").alias("_rest"),
    )
    salt = F.pmod(F.xxhash64("_ident"), F.lit(SALTS)).cast("int")
    plan = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = slim.withColumn("_salt", salt).join(plan, ["_leaf", "_salt"]).withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(F.col("_ident").cast("string"), F.lit(""))).cast("binary")))
    return ranks.ranked(keyed, "_leaf", "_key", ["_ident", *(f"_tie{i}" for i in range(len(ties)))], "tokens").select(
        *(F.col("_row").getField(c).alias(c) for c in own if c not in ("n_tokens", "leaf_tokens", "leaf_budget", "copies")),
        F.col("tokens").alias("n_tokens"),
        "leaf_tokens",
        "leaf_budget",
        (F.col("_whole") + (F.col("before") < F.col("_rest")).cast("bigint")).alias("copies"),
    )


def repeated(chosen: DataFrame) -> DataFrame:
    """The mixture itself: a row of :func:`mixed` for each of its ``copies``, with ``epoch`` from 0."""
    return chosen.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
