"""Near duplicates among embeddings: exact cosine joins over tiles, in the order of principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import graph, shared

#: Vectors of a tile's side at most, and of each of the two blocks that a task holds and compares tile by tile.
TILE, BLOCK = 1024, 8192
#: Vectors that the principal components are fitted on at most. Any rotation gives the same links; a good one prunes more.
SAMPLE = 8192
#: Leading components whose values deal vectors into cells; and how many components are added up before each look at the bounds.
CELLS, STEPS = 2, (4, 8, 16, 32)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def basis(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal directions of unit vectors, the widest first."""
    centred = sample - sample.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred)
    return vectors[:, np.argsort(-values, kind="stable")]


def tile_links(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors, in the rotated basis, whose product may reach ``least``.

    Leading components are multiplied first. What the others can add is at most the product of the two vectors' norms over them;
    rows and columns without a pair that can still reach ``least`` leave, and the tile ends when none is left.
    """
    i, j, dims = np.arange(len(x)), np.arange(len(y)), x.shape[1]
    done, partial = 0, np.zeros((len(x), len(y)))
    for step in [*(s for s in STEPS if s < dims), dims]:
        partial = partial + x[:, done:step] @ y[:, done:step].T
        done = step
        rest = np.sqrt((x[:, done:] ** 2).sum(axis=1))[:, None] * np.sqrt((y[:, done:] ** 2).sum(axis=1))[None, :]
        able = partial + rest >= least - 1e-9
        rows, columns = able.any(axis=1), able.any(axis=0)
        if not rows.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y, i, j, partial, able = x[rows], y[columns], i[rows], j[columns], partial[rows][:, columns], able[rows][:, columns]
    a, b = np.nonzero(able)
    return i[a], j[b]


def near_vectors(vectors: DataFrame, threshold: float, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``ident``, ``n_links``, ``component_id`` and ``kept`` of every vector.

    Two vectors are linked if their labels are equal and not null, their lengths are equal, and their cosine in double precision is ``threshold`` or more.
    A vector that is null, empty, zero, or holds null or non-finite components is linked with nothing: no links, its own component, kept.
    Equal vectors of a label are one class, joined once and counted by its size. The smallest ``ident`` that links reach is the component;
    a row of null ``ident`` is compared like any other if its class holds another ``ident``, else it stays alone. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    shared.ready_workers(spark)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col(label).isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(ident).alias("_id"), F.col(label).alias("_label"), F.when(usable, F.col(vector)).alias("_vector"))
    classes = rows.where("_vector is not null").groupBy("_label", "_vector").agg(F.min(F.col("_id").cast("bigint")).alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = shared.cut(classes.where("rep is not null").withColumn("_dims", F.size("_vector")))
    total = classes.count()
    place = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    taken: dict[int, list] = {}
    for r in classes.where(place < min(1.0, SAMPLE / max(total, 1))).select("_dims", "_vector").limit(2 * SAMPLE).collect():
        taken.setdefault(r[0], []).append(r[1])
    bases = spark.sparkContext.broadcast({d: basis(unit(np.array(v))) for d, v in taken.items()})  # a matrix for each length of vectors in the bounded sample
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-6  # unit vectors of that cosine are no farther apart, nor are any of their components

    def rotated(raw: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
        exact = unit(np.array(raw))
        return exact, exact @ bases.value.get(dims, np.eye(dims))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            cells = np.zeros((CELLS, len(raw)), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                lead = np.floor(rotated([raw[k] for k in at], int(d))[1][:, :CELLS] / reach).astype(np.int32)
                cells[: lead.shape[1], at] = lead.T
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in cells)], [*batch.schema.names, *(f"c{k}" for k in range(CELLS))])

    kinds = dict(classes.dtypes)
    own = ["_vector", "_dims", "_label", "rep", "n"]
    cells = [f"c{k}" for k in range(CELLS)]
    place_keys = ["_label", "_dims", *cells]
    placed = shared.cut(classes.select(*own).mapInArrow(celled, ", ".join([*(f"{c} {kinds[c]}" for c in own), *(f"{c} int" for c in cells)])))
    # Blocks of BLOCK vectors of a cell, and the pairs of blocks of equal or adjacent cells.
    blocks = placed.groupBy(*place_keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    near = blocks
    for c in cells:
        near = near.withColumn(f"_{c}", F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    other = blocks.select("_label", "_dims", *(F.col(c).alias(f"_{c}") for c in cells), F.col("chunks").alias("_chunks"))
    pairs = near.join(other, ["_label", "_dims", *(f"_{c}" for c in cells)])
    pairs = pairs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    a, b = F.struct(*cells, "chunk"), F.struct(*(F.col(f"_{c}").alias(c) for c in cells), F.col("_chunk").alias("chunk"))
    pairs = pairs.select("_label", "_dims", a.alias("a"), b.alias("b")).where("a <= b").withColumn("task", F.xxhash64("_label", "_dims", "a", "b"))
    sides = pairs.select("_label", "_dims", F.col("a.*"), "a", "b", "task", F.lit(0).alias("side")).union(pairs.where("a < b").select("_label", "_dims", F.col("b.*"), "a", "b", "task", F.lit(1).alias("side")))
    sized = placed.join(blocks, place_keys).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("chunks")).cast("int"))
    dealt = sized.join(sides, [*place_keys, "chunk"]).select("task", F.xxhash64("_label", "a", "b", F.lit(1)).alias("check"), "side", "rep", "n", "_dims", "_vector")
    dealt = dealt.repartition("task", "check").sortWithinPartitions("task", "check", "side", "rep")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(table: pa.Table) -> pa.RecordBatch | None:
            side, rep, n = (table.column(c).to_numpy() for c in ("side", "rep", "n"))
            exact, x = rotated(table.column("_vector").to_pylist(), table.column("_dims")[0].as_py())
            first = int((side == 0).sum())
            alone = first == len(side)
            left, right = np.arange(first), np.arange(first) if alone else np.arange(first, len(side))
            # Along the third component, tiles of which every pair is farther apart than the reach are passed over.
            along = x[:, min(CELLS, x.shape[1] - 1)]
            left, right = left[np.argsort(along[left], kind="stable")], right[np.argsort(along[right], kind="stable")]
            found = []
            for a in range(0, len(left), TILE):
                for b in range(0, len(right), TILE):
                    p, q = left[a : a + TILE], right[b : b + TILE]
                    if alone and b < a or along[q[0]] - along[p[-1]] > reach or along[p[0]] - along[q[-1]] > reach:
                        continue
                    i, j = tile_links(x[p], x[q], threshold)
                    i, j = p[i], q[j]
                    found.append((i[i < j], j[i < j]) if alone and a == b else (i, j))
            i, j = (np.concatenate([np.zeros(0, np.int64), *f]) for f in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            if not len(i):
                return None
            cosine = np.empty(len(i))
            for k in range(0, len(i), 1 << 16):  # the exact cosine of each pair
                cosine[k : k + (1 << 16)] = np.einsum("ij,ij->i", exact[i[k : k + (1 << 16)]], exact[j[k : k + (1 << 16)]])
            i, j = i[cosine >= threshold], j[cosine >= threshold]
            links = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
            top = graph.roots(len(rep), i, j)
            child, linked = np.flatnonzero(top != np.arange(len(rep))), np.flatnonzero(links)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[child], rep[linked]])), pa.array([*rep[top[child]].tolist(), *[None] * len(linked)], pa.int64()), pa.array(np.concatenate([np.zeros(len(child)), links[linked]]).astype(np.int64))],
                ["a", "b", "links"],
            )

        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            task, check = rest.column("task").to_numpy(), rest.column("check").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (check[1:] != check[:-1])]))
            for s, e in zip(starts[:-1], starts[1:]):
                if (out := tile(rest.slice(s, e - s))) is not None:
                    yield out
            rest = rest.slice(starts[-1])
        if rest is not None and rest.num_rows and (out := tile(rest)) is not None:
            yield out

    found = shared.cut(dealt.mapInArrow(compared, "a bigint, b bigint, links bigint"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    reached = graph.components(found.where("b is not null"), "a", "b")
    known = (
        classes.join(counts, classes.rep == counts.a, "left")
        .join(reached, classes.rep == reached.node, "left")
        .select("_label", F.xxhash64("_vector").alias("_hash"), "_vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    joined = rows.withColumn("_hash", F.xxhash64("_vector")).join(known, ["_label", "_hash", "_vector"], "left")
    component = F.coalesce("component_id", F.col("_id").cast("bigint"))
    return joined.select(F.col("_id").alias(ident), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
