"""Best-fit packing with Martello-Toth dominance reduction.

Texts become token ids plus an end id; longer ones are cut into pieces of ``capacity``.
Piece lengths take at most ``capacity`` different values, so the instance is its length
histogram (at most ``capacity`` rows, whatever the corpus): the reduction and the best
fit run on it and give *allocations*: the pieces with ranks [rank, rank + count) of a
length go to ``count`` consecutive sequences at one offset. Ranks within a length are
numbered on Spark (rank inside a task, plus the counts of earlier tasks), and every
piece finds its allocation by binary search in the broadcast table, whose size is
bounded by the histogram.

Defined results: a null or empty text is the end id alone (one piece of length 1); an
empty table packs to no rows; repeated rows are separate documents; ties in the search
go to the longest length and the oldest group; only the named columns are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import ship, stored
from ._text import blocks, columns
from ._tok import coder, encode_texts, words_apart

CAPACITY = 2048
END_ID = 0

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("task", pa.int64()), ("local_rank", pa.int64()), ("ids", pa.binary())])
_PIECE_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, local_rank bigint"
_OUT = ("doc_id", "piece", "start", "length", "ids_crc32")


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document with their task number and rank among the task's pieces of that length.

    The numbering holds for the stored result only: a caller must write it before using it.
    """
    ship(docs.sparkSession)
    keep_ids = with_ids
    schema = _PIECE if keep_ids else pa.schema(list(_PIECE)[:-1])
    apart = words_apart(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for x in batches:
            first = 0
            for b in blocks(x.column(1)):
                if apart:
                    ids, off = coder(path).encode(b)
                else:
                    lists = encode_texts(path, [b.data[i:j].tobytes().decode() for i, j in zip(b.offsets[:-1], b.offsets[1:])])
                    off = np.concatenate([[0], np.cumsum([len(v) for v in lists])]).astype(np.int64)
                    ids = np.array([i for v in lists for i in v], np.uint32)
                n = np.diff(off) + 1
                full = np.insert(ids.astype("<u4"), off[1:], end_id)
                doc_at = np.concatenate([[0], np.cumsum(n)])
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(b.rows), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                length = np.minimum(capacity, n[doc] - piece * capacity)
                raw = memoryview(full.tobytes())
                lo = (doc_at[doc] + piece * capacity) * 4
                cuts = [raw[i:i + k] for i, k in zip(lo.tolist(), (length * 4).tolist())]
                rank = pa_rank(length, seen)
                extra = {"ids": [bytes(c) for c in cuts]} if keep_ids else {}
                yield columns(schema, doc_id=x.column(0).slice(first, b.rows).take(pa.array(doc)), piece=piece,
                              start=piece * capacity, length=length, ids_crc32=[zlib.crc32(c) for c in cuts],
                              task=np.full(len(doc), task), local_rank=rank, **extra)
                first += b.rows

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(encode, _PIECE_DDL + (", ids binary" if keep_ids else ""))


def pa_rank(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each piece among those of its length, going on from ``seen`` (updated)."""
    order = np.argsort(length, kind="stable")
    s = length[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    at = np.arange(len(s))
    rank = np.empty(len(s), np.int64)
    rank[order] = at - np.maximum.accumulate(np.where(new, at, 0)) + seen[s]
    np.add.at(seen, length, 1)
    return rank


class Plan:
    """Allocations of a length histogram: (length, rank, count, sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {w: c for w, c in histogram.items() if c > 0}
        self.sizes = sorted(self.left)  # lengths with items left
        self.next_rank = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.reduced = 0
        self._reduce()
        self._best_fit()

    def _place(self, w: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((w, self.next_rank[w], count, sequence, offset))
        self.next_rank[w] += count
        self.left[w] -= count
        if not self.left[w]:
            del self.left[w]
            self.sizes.pop(bisect.bisect_left(self.sizes, w))

    def _fix(self, items: tuple[int, ...], times: int) -> None:
        """``times`` new sequences that hold ``items`` and are closed for good."""
        offset = 0
        for w in items:
            self._place(w, times, self.sequences, offset)
            offset += w
        self.sequences += times
        self.reduced += times * len(items)

    def _times(self, items: tuple[int, ...]) -> int:
        return min(self.left[w] // items.count(w) for w in set(items))

    def _smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest items left beside one item of length ``without``."""
        out: list[int] = []
        for w in self.sizes:
            c = self.left.get(w, 0) - (w == without)
            out += [w] * min(c, n - len(out))
            if len(out) >= n:
                break
        return out

    def _largest_fit(self, room: int, without: tuple[int, ...]) -> int | None:
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0:
            w = self.sizes[i]
            if self.left.get(w, 0) > without.count(w):
                return w
            i -= 1
        return None

    def _dominating(self, w: int) -> tuple[int, ...] | None:
        """A set holding ``w`` that dominates every other feasible set holding it."""
        room = self.capacity - w
        best = self._largest_fit(room, (w,))
        if best is None:
            return (w,)
        if best == room:
            return (w, best)
        three = self._smallest(3, w)
        if len(three) < 2 or three[0] + three[1] > room:
            return (w, best)  # at most one more item fits
        if len(three) == 3 and sum(three) <= room:
            return None
        # at most two more fit: their largest pair
        pair, top = None, 0
        for a in reversed(self.sizes[:bisect.bisect_right(self.sizes, room)]):
            if 2 * a < top or self.left.get(a, 0) <= (a == w):
                continue
            b = self._largest_fit(min(a, room - a), (w, a))
            if b is not None and a + b > top:
                pair, top = (a, b), a + b
        if pair is None or best >= top:
            return (w, best)
        if pair[0] == best and self._two_above(pair[1], (w, best)) > room:
            return (w, *pair)  # of any other two that fit, one is at most the pair's smaller and one at most its larger
        return None

    def _two_above(self, size: int, without: tuple[int, ...]) -> int:
        """Sum of the two smallest items longer than ``size``, or more than the capacity where there are not two."""
        out: list[int] = []
        for w in self.sizes[bisect.bisect_right(self.sizes, size):]:
            out += [w] * min(2 - len(out), self.left[w] - without.count(w))
            if len(out) == 2:
                return sum(out)
        return self.capacity + 1

    def _reduce(self) -> None:
        """Fix dominating sets, longest item first, until a pass fixes none."""
        changed = True
        while changed:
            changed = False
            for w in sorted(self.left, reverse=True):
                while self.left.get(w, 0):
                    found = self._dominating(w)
                    if found is None:
                        break
                    self._fix(found, self._times(found))
                    changed = True

    def _best_fit(self) -> None:
        """Best fit decreasing over groups of equal sequences (first sequence, count) by free room."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}

        def add(room: int, first: int, count: int) -> None:
            if count and room:
                if room not in groups:
                    bisect.insort(rooms, room)
                    groups[room] = []
                groups[room].append((first, count))

        for w in sorted(self.left, reverse=True):
            while self.left.get(w, 0):
                i = bisect.bisect_left(rooms, w)
                if i < len(rooms):
                    room = rooms[i]
                    first, count = groups[room].pop(0)
                    if not groups[room]:
                        del groups[room]
                        rooms.pop(i)
                else:
                    room, first = self.capacity, self.sequences
                    count = -(-self.left[w] // (self.capacity // w))
                    self.sequences += count
                each = room // w
                full = min(count, self.left[w] // each)
                for k in range(each if full else 0):
                    self._place(w, full, first, self.capacity - room + k * w)
                add(room - each * w, first, full)
                rest = min(self.left.get(w, 0), each) if full < count else 0
                if rest:
                    for k in range(rest):
                        self._place(w, 1, first + full, self.capacity - room + k * w)
                    add(room - rest * w, first + full, 1)
                add(room, first + full + bool(rest), count - full - bool(rest))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids, on request)."""
    pieces = stored(token_pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = stored(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    table = allocations(Plan(histogram, capacity).rows, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    out_names = (*_OUT, *(("ids",) if with_ids else ()))
    schema = pa.schema([_PIECE.field(c) for c in out_names] + [("sequence_id", pa.int64()), ("offset", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank, sequence, offset, step = shared.value
        for x in batches:
            length = x.column("length").to_numpy()
            r = x.column("rank").to_numpy()
            row = np.searchsorted(keys, length * step + r, "right") - 1
            yield columns(schema, **{c: x.column(c) for c in out_names}, sequence_id=sequence[row] + r - rank[row],
                          offset=offset[row])

    ranked = pieces.join(base, ["task", "length"]).select(*out_names, (F.col("base") + F.col("local_rank")).alias("rank"))
    ddl = ", ".join([_PIECE_DDL.rsplit(", task", 1)[0], *(("ids binary",) if with_ids else ())])
    return ranked.mapInArrow(assign, ddl + ", sequence_id bigint, offset bigint")


def allocations(rows: list[tuple[int, int, int, int, int]], capacity: int):
    """The plan as arrays sorted by (length, rank); the search key is length * step + rank."""
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    step = int((a[:, 1] + a[:, 2]).max()) + 1 if len(a) else 1
    if step * (capacity + 1) > 2**62:
        raise ValueError("more pieces than the search key can number")
    return a[:, 0] * step + a[:, 1], a[:, 1], a[:, 3], a[:, 4], step
