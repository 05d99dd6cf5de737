"""Byte-level BPE as a monoid: halves are encoded apart, and neighbours are joined by encoding a growing window at the seam anew.

A text is a tree of halves down to ``LEAF`` characters. What stands for a stretch of text are the pieces that the splitting pattern cuts it into, each with
its tokens. Two joins make it a monoid, and each ends its window where all tokens outside are proven to be those of the whole.

Pieces. The pattern looks at no character before a match, and at most at ``LOOK`` characters after it (``'ll`` after an apostrophe; the first
two characters after white space that is no whole run). So a match of the left half that ends ``LOOK`` characters or more before the seam is a match of the
whole. From the last of these on, matches are made anew, one by one, until one ends where a piece of the right half begins: from there
on both read the same characters from the same place, so all further pieces are those of the right half.

Tokens of a long piece. A row of tokens is what merging by ranks makes of its bytes if and only if it is so for every two neighbours by themselves.
For consider the first merge over a border between two tokens t, u of a row: until then, merges inside t and u are those that happen to the bytes of
t u alone, in the same order, as each is the one of the lowest rank, leftmost, among fewer; so the same merge happens to t u alone, and
they are no right neighbours; and the other way round. So the tokens around a seam are merged anew, ever more of
them, until the two borders of the window are between right neighbours.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared, words

#: Characters of a leaf of the text's tree, and of a leaf of a long piece's tree (a power of two).
LEAF, SHORT = 256, 16
#: Characters after a match that the splitting pattern may look at.
LOOK = 2
#: Pieces of more characters get their tokens last, when no seam can lie in them any more. No token is that long.
LONG = 256
#: Tokens on each side of a seam in the first window, and tokens of a leaf of the decoding tree.
WINDOW, TOKENS = 2, 8192
#: Bytes that are merged by looking through all pairs; more are merged by a heap.
SCAN = 512
#: Bytes of the first results that a memo keeps as long as its worker lives, and of later ones, which are forgotten at this size and when a task ends.
FIRST, LATER = 24 << 20, 24 << 20

_NONE = 1 << 60


class Memo:
    """Results that were found before. The first ones stay, which holds what is frequent; later ones are forgotten when they outgrow their bytes.

    A worker outlives its task and waits beside those of other stages, so what it remembers counts against theirs.
    """

    def __init__(self, first: int = FIRST, later: int = LATER):
        self._bytes = first, later
        self.clear()

    def get(self, key):
        found = self.first.get(key)
        return self.later.get(key) if found is None else found

    def put(self, key, value, size: int) -> None:
        """``size``: bytes of the key and the value; a place in the dictionary takes about 100 more."""
        size += 100
        if size <= self._room:
            self._room -= size
            self.first[key] = value
            return
        if self._held + size > self._most:
            self.forget()
        self._held += size
        self.later[key] = value

    def forget(self) -> None:
        self.later.clear()
        self._held = 0

    def clear(self) -> None:
        self.first: dict = {}
        self.later: dict = {}
        self._held, (self._room, self._most) = 0, self._bytes


class Coder:
    """Encoding and decoding by the ranks of a vocabulary file."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self._ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self._bytes: list[bytes | None] = [None] * (max(self._ranks.values()) + 1)
        for b, i in self._ranks.items():
            self._bytes[i] = b
        self._one = [bytes([b]) for b in range(256)]
        self._two = [self._ranks.get(a + b, _NONE) for a in self._one for b in self._one]
        self._pattern = regex.compile(pattern)
        self._pieces, self._parts, self._neighbours = Memo(), Memo(FIRST // 4, LATER // 4), Memo(FIRST // 4, LATER // 4)
        self.names = [str(i) for i in range(len(self._bytes))]
        self.joins = 0

    def forget(self) -> None:
        """Leaves of the memos what stays from task to task."""
        for memo in (self._pieces, self._parts, self._neighbours):
            memo.forget()

    # Merging bytes

    def _merged(self, data: bytes) -> list[int]:
        """Tokens of some bytes: again and again, the two neighbours of the lowest rank, leftmost first, become one."""
        if len(data) > SCAN:
            return self._merged_by_heap(data)
        get, made, one, two = self._ranks.get, self._bytes, self._one, self._two
        parts = [one[b] for b in data]
        ranks = [two[a << 8 | b] for a, b in zip(data, data[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            at, new = ranks.index(best), made[best]
            parts[at] = new
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(new + parts[at + 1], _NONE)
            if at:
                ranks[at - 1] = get(parts[at - 1] + new, _NONE)
        return [get(x) for x in parts]

    def _merged_by_heap(self, data: bytes) -> list[int]:
        get, n = self._ranks.get, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at a place; 0 where none does any more
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapify(waiting)
        while waiting:
            _, a, c = heappop(waiting)
            b = end[a]
            if not b or b >= n or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                if (r := get(data[a : end[c]])) is not None:
                    heappush(waiting, (r, a, end[c]))
            if a and (r := get(data[before[a] : c])) is not None:
                heappush(waiting, (r, before[a], c))
        out, at = [], 0
        while at < n:
            out.append(self._ranks[data[at : end[at]]])
            at = end[at]
        return out

    def _remembered(self, data: bytes) -> list[int]:
        found = self._parts.get(data)
        if found is None:
            found = self._merged(data)
            self._parts.put(data, found, 100 + len(data) + 40 * len(found))
        return found

    def _right_neighbours(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens by themselves become these two."""
        found = self._neighbours.get((a, b))
        if found is None:
            found = self._merged(self._bytes[a] + self._bytes[b]) == [a, b]
            self._neighbours.put((a, b), found, 120)
        return found

    def _seam(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbours' bytes together; what stands in ``left`` is used up."""
        size = WINDOW
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            first, rest = len(left) - a, right[b:]
            again = self._remembered(b"".join([self._bytes[i] for i in chain(left[first:], right[:b])]))
            if (not first or self._right_neighbours(left[first - 1], again[0])) and (not rest or self._right_neighbours(again[-1], rest[0])):
                left[first:] = again
                left += rest
                return left
            size *= 2

    def _tree(self, piece: str) -> list[int]:
        """Tokens of a piece: of halves, the left one a power of two characters long, so that rows of one character are cut alike."""
        if len(piece) <= SHORT:
            return list(self._remembered(piece.encode()))
        half = 1 << ((len(piece) - 1).bit_length() - 1)
        return self._seam(self._tree(piece[:half]), self._tree(piece[half:]))

    # Splitting text

    def _piece(self, piece: str) -> bytes | None:
        """Tokens of a piece, four bytes each; None, for now, of a long one."""
        found = self._pieces.get(piece)
        if found is None and len(piece) <= LONG:
            data = piece.encode()
            whole = self._ranks.get(data)
            found = array("I", [whole] if whole is not None else self._merged(data) if len(piece) <= SHORT else self._tree(piece)).tobytes()
            self._pieces.put(piece, found, 80 + 4 * len(piece) + len(found))
        return found

    def _element(self, text: str, low: int, high: int) -> tuple[list[str], list[bytes | None]]:
        """The pieces of text[low:high], and their tokens."""
        if high - low <= LEAF:
            pieces = self._pattern.findall(text, low, high)
            ids = list(map(self._pieces.first.get, pieces))
            if None in ids:
                ids = [self._piece(p) if x is None else x for x, p in zip(ids, pieces)]
            return pieces, ids
        seam = low + (LEAF << (((high - low - 1) // LEAF).bit_length() - 1))
        return self._joined(text, low, seam, high, self._element(text, low, seam), self._element(text, seam, high))

    def _joined(self, text: str, low: int, seam: int, high: int, left: tuple, right: tuple) -> tuple[list[str], list[bytes | None]]:
        (pieces, ids), (right_pieces, right_ids) = left, right
        self.joins += 1
        at, keep = seam, len(pieces)
        while keep and at > seam - LOOK:
            keep -= 1
            at -= len(pieces[keep])
        del pieces[keep:], ids[keep:]
        place, skip = seam, 0  # how far the window reaches into the right half, and over how many of its pieces
        while at < high:
            while place < at:
                place += len(right_pieces[skip])
                skip += 1
            if place == at:
                break
            found = self._pattern.match(text, at, high).group()
            at += len(found)
            pieces.append(found)
            ids.append(self._piece(found))
        else:
            return pieces, ids
        pieces += right_pieces[skip:]
        ids += right_ids[skip:]
        return pieces, ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not text:
            return np.zeros(0, np.uint32)
        pieces, ids = self._element(text, 0, len(text))
        if None in ids:
            ids = [array("I", self._tree(p)).tobytes() if x is None else x for p, x in zip(pieces, ids)]
        if sum(map(len, pieces)) != len(text):
            raise ValueError("the pattern leaves characters out")
        return np.frombuffer(b"".join(ids), np.uint32)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, concatenated up the tree; ids need not end at a character."""
        if len(ids) <= TOKENS:
            return b"".join(map(self._bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_coders: dict[str, Coder] = {}


def coder(ranks_file: bytes, pattern: str) -> Coder:
    """The coder of a file; a worker builds it once."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks_file, pattern)
    return _coders[key]


def forget() -> None:
    """At a task's end: the worker's coder keeps little."""
    for own in _coders.values():
        own.forget()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint32), *rows]).astype(np.int32)))


def _mapped(docs: DataFrame, path: str, pattern: str, ident: str, text: str, kinds: str, values) -> DataFrame:
    with open(path, "rb") as f:  # under a megabyte, and of fixed size: the vocabulary goes to the workers with the broadcast
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(file.value, pattern)
        given = batch.column(1).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), *values(own, [words.decoded(t) if isinstance(t, bytes) else t for t in given])], names)

    names = [ident, *(k.split()[0] for k in kinds.split(", "))]
    given = F.col(text).cast("binary") if dict(docs.dtypes)[text] == "string" else F.col(text)
    return words.map_batches(docs.select(ident, given.alias("_given")), run, f"`{ident}` {dict(docs.dtypes)[ident]}, {kinds}", forget)


def encoded(docs: DataFrame, path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident`` and ``ids``, the token ids of the whole text; none for null and empty texts. Equal texts have equal ids; a text without any white space is one piece, however long."""

    def values(own: Coder, texts: list[str | None]) -> list[pa.Array]:
        return [_lists([own.encode(t or "") for t in texts])]

    return _mapped(docs, path, pattern, ident, text, "ids array<int>", values)


def decoded(rows: DataFrame, path: str, pattern: str, ident: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``ident`` and ``bytes``, what the ids stand for; nothing for null."""

    def values(own: Coder, lists: list[list[int] | None]) -> list[pa.Array]:
        return [pa.array([own.decode(x or []) for x in lists], pa.binary())]

    return _mapped(rows, path, pattern, ident, ids, "bytes binary", values)


def digests(docs: DataFrame, path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, ``n_tokens``, and the SHA-256 of the ids (decimal, joined by a space) and of the bytes that they decode to. A null text counts as empty."""

    def values(own: Coder, texts: list[str | None]) -> list[pa.Array]:
        n, ids_sum, decoded_sum = [], [], []
        name = own.names.__getitem__
        for t in texts:
            ids = own.encode(t or "").tolist()
            n.append(len(ids))
            ids_sum.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
            decoded_sum.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sum, pa.string()), pa.array(decoded_sum, pa.string())]

    return _mapped(docs, path, pattern, ident, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", values)


def encoded_rows(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows with ``ids``, ``n_tokens`` and ``round_trip`` (the ids decode to the text) in place of the text; null counts as empty.

    Columns of the results' names are replaced; all others stay.
    """
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    keep, kinds = [c for c in docs.columns if c not in (text, "ids", "n_tokens", "round_trip")], dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(file.value, pattern)
        texts = [words.decoded(t) for t in batch.column(0).to_pylist()]
        ids = [own.encode(t) for t in texts]
        same = [own.decode(i.tolist()) == t.encode() for i, t in zip(ids, texts)]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], _lists(ids), pa.array([len(i) for i in ids], pa.int64()), pa.array(same)], [*keep, "ids", "n_tokens", "round_trip"])

    return words.map_batches(docs.select(F.col(text).cast("binary").alias(shared.fresh(keep, "_text")), *keep), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>", "n_tokens bigint", "round_trip boolean"]), forget)
