"""Numeric columns as binary rows: many rows of a shard travel through a shuffle as one.

A worker cuts sorted rows into shards by the leading bits of a hash, and packs each shard's columns into one value; a task then reads
whole shards into arrays. It spares the cost of a row for each number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Columns of the rows.
SCHEMA = "kind string, shard int, data binary"


def fewest(top: int) -> str:
    """The smallest unsigned type that holds ``top``."""
    return next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max)


def packed(columns: list[np.ndarray], plain: bool = False) -> bytes:
    """Columns of equal length as bytes.

    Numbers take the fewest bytes that hold them. Hashes are given as their distinct values and places where that is shorter; places that rise, as
    steps, which compress well. ``plain`` leaves both out, for hashes that seldom repeat.
    """
    out = [np.array([len(columns), len(columns[0])], "<u8").tobytes()]
    for c in columns:
        kind, values, steps = fewest(int(c.max()) if len(c) else 0), None, 0
        if kind == "<u8" and len(c) > 64 and not plain:
            values, place = np.unique(c, return_inverse=True)
            if steps := int((place[1:] >= place[:-1]).all()):
                place = np.diff(place, prepend=0)
            small = fewest(int(place.max()))
            if 8 * len(values) + int(small[-1]) * len(c) < 8 * len(c):
                c, kind = place, small
            else:
                values, steps = None, 0
        out += [kind[1:].encode(), np.array([0 if values is None else len(values), steps], "<u8").tobytes(), b"" if values is None else values.astype("<u8").tobytes(), c.astype(kind).tobytes()]
    return b"".join(out) if plain else zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(blob: bytes, plain: bool = False) -> list[np.ndarray]:
    raw = blob if plain else zstandard.ZstdDecompressor().decompress(blob)
    (n, rows), at, out = (int(x) for x in np.frombuffer(raw, "<u8", 2)), 16, []
    for _ in range(n):
        kind, (distinct, steps) = np.dtype("<" + raw[at : at + 2].decode()), (int(x) for x in np.frombuffer(raw, "<u8", 2, at + 2))
        values = np.frombuffer(raw, "<u8", distinct, at + 18)
        at += 18 + 8 * distinct
        found = np.frombuffer(raw, kind, rows, at)
        at += rows * kind.itemsize
        if distinct:
            found = values[np.cumsum(found, dtype=np.int64) if steps else found]
        out.append(found.astype(np.uint64))
    return out


def dealt(kind: str, columns: list[np.ndarray], by: np.ndarray, shards: int, arrange: bool = False, plain: bool = False) -> Iterator[tuple[str, int, bytes]]:
    """The rows cut into shards by the leading bits of ``by``, which is in order; inside a shard in the first column's order, if ``arrange``."""
    if not len(by):
        return
    edges = np.searchsorted(by, (np.arange(1, shards, dtype=np.uint64) << np.uint64(64 - (shards - 1).bit_length())), "left")
    for s, (a, b) in enumerate(zip([0, *edges], [*edges, len(by)])):
        if b > a:
            own = [c[a:b] for c in columns]
            if arrange:
                order = np.argsort(own[0])
                own = [c[order] for c in own]
            yield kind, s, packed(own, plain)


def record_batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "shard", "data"])


def in_rows(rows: Iterator[tuple[str, int, bytes]], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += len(r[2])
        if total >= size:
            yield record_batch(held)
            held, total = [], 0
    if held:
        yield record_batch(held)
