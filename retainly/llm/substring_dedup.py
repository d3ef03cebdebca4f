"""Removal of long repeated passages with difference-cover anchors.

A window is ``WINDOW`` consecutive words. A word goes if a window covering it also
starts in a document with a smaller id. The cover {1, 2, 4} modulo 7 holds, for any two
alignments, a shift below 7 that brings both onto cover positions. So hashing only the
7-word anchors that start at cover positions, two equal windows share an anchor at one
and the same shift, and 7 - 1 + 7 = 13 words hold it.

1. One pass counts anchors and windows in two fixed-size tables of hashed counters. Cells
   far above the median are common.
2. Anchors of common cells are taken as repeated without a shuffle (a superset: step 3
   decides). All others are shuffled by hash once; those seen in two documents go back to
   their documents. No group there is larger than the common limit.
3. Around each repeated anchor the match is extended to all windows that hold it; these
   are hashed whole and the smallest document of each is found: by one shuffle for windows
   of ordinary cells, by partial aggregation and a join for windows of common cells, which
   may be in any share of the documents.
4. Documents with windows found in a smaller document lose the covered words.

Defined results: null, empty or word-less text has no words and the digest of the empty
string; texts shorter than a window lose nothing; rows that share a doc_id are not
compared with each other and are each returned; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import id_filter, ship, stored, thinned
from ._text import Block, blocks, columns, keyed, window_hashes, word_hashes

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
CELLS = 1 << 18

_ON_COVER = np.isin(np.arange(PERIOD), COVER)
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_DIGEST_DDL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def anchor_width(window: int) -> int:
    """Words of an anchor: every anchor at a shift below the period still lies inside the window."""
    return window - PERIOD + 1


def anchors(b: Block, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the anchors at cover positions."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero((b.doc[:n] == b.doc[width - 1:]) & _ON_COVER[place(b)[:n] % PERIOD])
    return at, window_hashes(h, at, width)


def place(b: Block) -> np.ndarray:
    """Position of each word in its document."""
    c = b.counts
    return np.arange(len(b.doc)) - (np.cumsum(c) - c)[b.doc]


def cells(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int64)


def _common_cells(docs: DataFrame, window: int, n_cells: int):
    """Broadcast (rows, common anchor cells, common window cells)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, n_cells), np.int64), 0
        for x in batches:
            rows += x.num_rows
            for b in blocks(x.column(1)):
                h = word_hashes(b)
                a = anchors(b, h, anchor_width(window))[1]
                w = all_windows(b, h, window)[1]
                for k, v in enumerate((a, w)):
                    seen[k] += np.bincount(cells(v, n_cells), minlength=n_cells)
        schema = pa.schema([("kind", pa.int32()), ("cell", pa.int32()), ("seen", pa.int64())])
        yield columns(schema, kind=[2], cell=[0], seen=[rows])
        for k in (0, 1):
            used = np.flatnonzero(seen[k])
            yield columns(schema, kind=np.full(len(used), k, np.int32), cell=used.astype(np.int32), seen=seen[k][used])

    got = (docs.mapInArrow(run, "kind int, cell int, seen bigint").groupBy("kind", "cell").agg(F.sum("seen").alias("seen"))
           .toArrow())  # at most 2 * n_cells + 1 rows
    kind, cell, count = (got[c].to_numpy() for c in ("kind", "cell", "seen"))
    total = np.zeros((3, n_cells), np.int64)
    total[kind, cell] = count
    common = []
    for k in (0, 1):
        middle = np.median(total[k])
        common.append(total[k] > middle + 6 * np.sqrt(middle) + 32)
    return docs.sparkSession.sparkContext.broadcast((int(total[2, 0]), *common))


def all_windows(b: Block, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(b.doc[:n] == b.doc[window - 1:])
    return at, window_hashes(h, at, window)


def _anchor_rows(docs: DataFrame, shared, window: int, n_cells: int) -> DataFrame:
    """Distinct (anchor, doc) of ordinary cells, and one row marked common for a document with a common anchor."""
    schema = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("common", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value[1]
        for x in batches:
            for b in blocks(x.column(1)):
                ids = x.column(0).slice(b.first, b.rows).to_numpy(zero_copy_only=False)
                at, a = anchors(b, word_hashes(b), anchor_width(window))
                rows = b.doc[at]
                hot = common[cells(a, n_cells)]
                marked = np.unique(rows[hot])
                a, rows = a[~hot], rows[~hot]
                _, first = np.unique(keyed(a, rows), return_index=True)
                first.sort()
                a, rows = a[first], rows[first]
                for i in range(0, len(a), 200_000):
                    j = slice(i, i + 200_000)
                    yield columns(schema, anchor=a[j].view(np.int64), doc=ids[rows[j]], common=np.zeros(len(a[j]), bool))
                yield columns(schema, anchor=ids[marked].astype(np.int64), doc=ids[marked], common=np.ones(len(marked), bool))

    return docs.mapInArrow(run, "anchor bigint, doc bigint, common boolean")


def _window_rows(matched: DataFrame, shared, window: int, n_cells: int, of_common: bool) -> DataFrame:
    """Distinct (window, doc) around repeated anchors, of common or of ordinary cells."""
    schema = pa.schema([("window", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, common_a, common_w = shared.value
        for x in batches:
            values, off = list_parts(x.column(2))
            for b in blocks(x.column(1)):
                ids = x.column(0).slice(b.first, b.rows).to_numpy(zero_copy_only=False)
                h = word_hashes(b)
                at, a = anchors(b, h, anchor_width(window))
                own = slice(off[b.first], off[b.first + b.rows])
                owner = np.repeat(np.arange(b.rows), np.diff(off[b.first:b.first + b.rows + 1]))
                again = common_a[cells(a, n_cells)] | np.isin(keyed(a, b.doc[at]), keyed(values[own], owner))
                hit = np.zeros(len(h) + 1, np.int64)
                hit[at[again] + 1] = 1
                hit = np.cumsum(hit)
                i, w = all_windows(b, h, window)
                near = hit[np.minimum(i + PERIOD, len(h))] > hit[i]  # an anchor starts in the first PERIOD words
                i, w = i[near], w[near]
                take = common_w[cells(w, n_cells)] == of_common
                i, w = i[take], w[take]
                rows = b.doc[i]
                _, first = np.unique(keyed(w, rows), return_index=True)
                for k in range(0, len(first), 200_000):
                    f = first[k:k + 200_000]
                    yield columns(schema, window=w[f].view(np.int64), doc=ids[rows[f]])

    return matched.mapInArrow(run, "window bigint, doc bigint")


def list_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (as unsigned hashes) and offsets of a list<int64> column; null lists are empty."""
    size = np.array([0 if n is None else n for n in _lengths(col)], np.int64)
    off = np.zeros(len(col) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), off


def _lengths(col: pa.Array):
    import pyarrow.compute as pc
    return pc.list_value_length(col).to_pylist()


def kept_digests(b: Block, keep: np.ndarray) -> list[str]:
    """SHA-256 of each row's kept words joined by one space."""
    size = len(b.data) - 8
    starts, ends, doc = b.starts[keep], b.ends[keep], b.doc[keep]
    edge = np.zeros(size + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    mask = np.cumsum(edge[:size], dtype=np.int8).astype(bool)
    data = b.data[:size].copy()
    follows = np.zeros(len(starts), bool)
    follows[1:] = doc[1:] == doc[:-1]
    gap = starts[follows] - 1  # white space before a kept word that is not the first
    mask[gap] = True
    data[gap] = 0x20
    off = np.zeros(size + 1, np.int64)
    np.cumsum(mask, out=off[1:])
    off = off[b.offsets]
    out = memoryview(data[mask].tobytes())
    return [hashlib.sha256(out[i:j]).hexdigest() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]


def dedup_digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  n_cells: int = CELLS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256."""
    if window < PERIOD:
        raise ValueError("a window must be at least as long as the cover's period")
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    matched, removed, _ = _matches(narrow, window, n_cells)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for b in blocks(x.column(1)):
                yield columns(_DIGEST, doc_id=x.column(0).slice(b.first, b.rows), n_words=b.counts,
                              n_removed=np.zeros(b.rows, np.int64), kept_sha256=kept_digests(b, np.ones(len(b.doc), bool)))

    def thinned_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            values, off = list_parts(x.column(2))
            for b in blocks(x.column(1)):
                cut = _cut_words(b, values, off, window)
                yield columns(_DIGEST, doc_id=x.column(0).slice(b.first, b.rows), n_words=b.counts,
                              n_removed=np.bincount(b.doc[cut], minlength=b.rows), kept_sha256=kept_digests(b, ~cut))

    untouched = narrow.mapInArrow(whole, _DIGEST_DDL).join(removed.select("doc_id"), "doc_id", "left_anti")
    changed = (matched.select("doc_id", "text").join(removed, "doc_id").select("doc_id", "text", "windows")
               .mapInArrow(thinned_text, _DIGEST_DDL))
    return untouched.unionByName(changed)


def _cut_words(b: Block, values: np.ndarray, off: np.ndarray, window: int) -> np.ndarray:
    """Words covered by a window of the row's list."""
    h = word_hashes(b)
    i, w = all_windows(b, h, window)
    own = slice(off[b.first], off[b.first + b.rows])
    owner = np.repeat(np.arange(b.rows), np.diff(off[b.first:b.first + b.rows + 1]))
    at = i[np.isin(keyed(w, b.doc[i]), keyed(values[own], owner))]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:len(h)] > 0


def _matches(narrow: DataFrame, window: int, n_cells: int):
    """(texts with repeated anchors, (doc_id, windows to remove) per document, the counters)."""
    shared = _common_cells(narrow, window, n_cells)
    given = narrow.filter("doc_id IS NOT NULL")
    group = Window.partitionBy("anchor", "common")
    again = (_anchor_rows(given, shared, window, n_cells)
             .withColumn("lo", F.min("doc").over(group)).withColumn("hi", F.max("doc").over(group))
             .filter("common OR lo < hi"))
    lists = stored(again.groupBy("doc").agg(F.collect_list(F.when(~F.col("common"), F.col("anchor"))).alias("anchors")), "anchors")
    some = thinned(given, "doc_id", id_filter(lists.select("doc"), shared.value[0]))
    matched = stored(some.join(lists, some["doc_id"] == lists["doc"]).select("doc_id", "text", "anchors"), "matched")

    rare = _window_rows(matched, shared, window, n_cells, False)
    rare = rare.withColumn("lo", F.min("doc").over(Window.partitionBy("window"))).filter("doc > lo").select("window", "doc")
    hot = _window_rows(matched, shared, window, n_cells, True)
    first = hot.groupBy("window").agg(F.min("doc").alias("lo"))
    hot = hot.join(first, "window").filter("doc > lo").select("window", "doc")
    removed = stored(rare.union(hot).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("window").alias("windows")), "removed")
    return matched, removed, shared
