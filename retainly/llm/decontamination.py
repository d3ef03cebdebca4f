"""Benchmark decontamination: BM25 inverted index with block-max pruning, then overlap checks.

Test items are cut into segments of at most ``SEGMENT`` words. Their inverted index holds
BM25 impacts divided by the segment's score for its own text, so 1 is a full match and one
threshold serves all. Every training text is cut into passages of two half-blocks of
``SEGMENT`` words that overlap by one, so any segment copied into a text lies whole in a
passage. Each passage is a query, in three steps, each on what the last one left:

1. term bounds: the best impact of every term of the passage, summed, reaches the threshold;
2. block bounds: segments are sorted into blocks of ``BLOCK``; the block maxima of the
   passage's selective terms plus the block's most from the other terms reach it;
3. the segments of the remaining blocks are scored in full.

No bound is ever below a true score, so every (passage, segment) at or above the threshold
is retrieved. Retrieval only picks the item: all its distinct 5-word shingles are then looked
up in the whole text, those of its question (all sentences but the last) and answer (the last
sentence; of a single sentence, its last quarter) apart; shingles across the border count for
the item alone. A document leaks an item when at least ``percent`` of the item's shingles
occur, or of its question's, if that has ``QUESTION`` of them at least. A question
shorter than a segment is a segment of its own beside the item's, so it is retrieved alone.

The index goes to the executors in parts of at most ``INDEX_WORDS`` words, one pass over
the documents each, so no broadcast grows with the benchmark.

Defined results: null or word-less texts and items match nothing; an item shorter than a
shingle is one shingle; items with equal text are all reported; repeated documents and
items are reported as often as they occur; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ship
from ._text import Block, blocks, columns, make_block, string_parts, word_hashes
from .jaccard_join import shingles

SEGMENT = 64
SHINGLE = 5
BLOCK = 8
THRESHOLD = 0.4
PERCENT = 75
QUESTION = 8  # shingles of a question that is a leak without its answer
INDEX_WORDS = 2_000_000
K1, B = 1.2, 0.75
SELECTIVE_SHARE = 0.05  # terms in more of the segments are left to the per-block rest
CELLS_AT_ONCE = 4_000_000

_SENTENCE = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()),
                    ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
MATCH_DDL = ("doc_id bigint, item_id bigint, score double, overlap double, question_overlap double, answer_overlap double")


@dataclass
class Index:
    """Inverted index of a part of the items; arrays over segments, terms or postings."""

    item: np.ndarray           # item number of each segment
    item_ids: list             # id of each item, which may be null
    shingle: np.ndarray        # sorted distinct shingle hashes of items, flat
    shingle_at: np.ndarray
    part: np.ndarray           # per shingle: 0 in the question, 1 in the answer, 2 across the border
    terms: np.ndarray          # sorted term hashes
    known: np.ndarray          # 2**16 flags over the terms' low bits
    post_at: np.ndarray        # postings of a term
    post_segment: np.ndarray
    post_impact: np.ndarray
    best: np.ndarray           # per term: largest impact
    selective: np.ndarray
    max_at: np.ndarray         # block maxima of a selective term
    max_block: np.ndarray
    max_impact: np.ndarray
    rest: np.ndarray           # per block: most that the other terms add to one of its segments


def answer_start(text: str) -> int:
    """Index of the first word of the answer."""
    parts = [p for p in _SENTENCE.split(text) if _WORD.search(p)]
    n = len(_WORD.findall(text))
    return n - len(_WORD.findall(parts[-1])) if len(parts) > 1 else n - max(1, n // 4)


def block_of_texts(texts: list[str]) -> Block:
    data, off = string_parts(pa.array(texts, pa.large_string()))
    return make_block(data, off, 0, len(texts), True)


def build_index(items: list[tuple[int, str]], segment: int = SEGMENT) -> Index:
    """Items are (id, text with a word)."""
    b = block_of_texts([t for _, t in items])
    h = word_hashes(b)
    n = b.counts
    first = np.cumsum(n) - n
    seg_item, seg_words, sh, sh_part = [], [], [], []
    step = segment - SHINGLE + 1
    row_of, s = shingles(b, SHINGLE)
    order = np.argsort(row_of, kind="stable")
    row_of, s = row_of[order], s[order]
    s_first = np.searchsorted(row_of, np.arange(len(items)))
    for i, (_, text) in enumerate(items):
        border = answer_start(text)
        total = max(1, int(n[i]) - SHINGLE + 1)
        for at in range(0, total, step):
            seg_item.append(i)
            seg_words.append(np.unique(h[first[i] + at:min(first[i] + at + segment, first[i] + n[i])], return_counts=True))
        values, place = np.unique(s[s_first[i]:s_first[i] + total], return_index=True)
        sh.append(values)
        sh_part.append(np.where(place >= border, 1, np.where(place + SHINGLE <= border, 0, 2)))
        if QUESTION + SHINGLE - 1 <= border < segment:
            seg_item.append(i)
            seg_words.append(np.unique(h[first[i]:first[i] + border], return_counts=True))
    n_seg = len(seg_item)
    size = np.array([c.sum() for _, c in seg_words], float)
    term_of = np.concatenate([w for w, _ in seg_words])
    tf = np.concatenate([c for _, c in seg_words]).astype(float)
    seg_of = np.repeat(np.arange(n_seg), [len(w) for w, _ in seg_words])
    terms, t, df = np.unique(term_of, return_inverse=True, return_counts=True)
    idf = np.log1p((n_seg - df + 0.5) / (df + 0.5))
    impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[seg_of] / size.mean()))
    impact = impact / np.bincount(seg_of, weights=impact, minlength=n_seg)[seg_of]
    by_term = np.lexsort((seg_of, t))
    t, seg_of, impact = t[by_term], seg_of[by_term], impact[by_term]
    post_at = np.searchsorted(t, np.arange(len(terms) + 1))
    selective = df <= max(2, SELECTIVE_SHARE * n_seg)
    blk = seg_of // BLOCK
    n_blocks = -(-n_seg // BLOCK)
    on = selective[t]
    rest_seg = np.bincount(seg_of[~on], weights=impact[~on], minlength=n_seg)
    rest = np.zeros(n_blocks)
    np.maximum.at(rest, np.arange(n_seg) // BLOCK, rest_seg)
    key = t[on] * n_blocks + blk[on]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    tops = np.maximum.reduceat(impact[on], np.flatnonzero(new)) if len(key) else np.zeros(0)
    key = key[new]
    known = np.zeros(1 << 16, bool)
    known[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Index(np.array(seg_item), [i for i, _ in items], np.concatenate(sh),
                 np.concatenate([[0], np.cumsum([len(x) for x in sh])]), np.concatenate(sh_part), terms, known, post_at,
                 seg_of, impact, np.maximum.reduceat(impact, post_at[:-1]), selective,
                 np.searchsorted(key // n_blocks, np.arange(len(terms) + 1)), key % n_blocks, tops, rest)


def ranges(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, element) for ranges [lo, lo + size)."""
    which = np.repeat(np.arange(len(lo)), size)
    return which, np.arange(len(which)) + np.repeat(lo - (np.cumsum(size) - size), size)


def retrieve(b: Block, h: np.ndarray, x: Index, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, segment, best score) of every segment that some passage of the row reaches."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    cand = np.flatnonzero(x.known[(h & np.uint64(0xFFFF)).astype(np.int64)])
    t = np.searchsorted(x.terms, h[cand])
    ok = t < len(x.terms)
    ok[ok] = x.terms[t[ok]] == h[cand[ok]]
    cand, t = cand[ok], t[ok]
    if not len(t):
        return none
    n = b.counts
    halves = np.maximum(1, -(-n // SEGMENT))
    half_at = np.cumsum(halves) - halves
    doc = b.doc[cand]
    half = half_at[doc] + (cand - (np.cumsum(n) - n)[doc]) // SEGMENT
    # passage k is half-blocks k and k + 1 of a row (a last half alone is part of the one before, unless it is the only one)
    second = half > half_at[doc]
    is_start = (half + 1 < half_at[doc] + halves[doc]) | ~second
    pas = np.concatenate([half[is_start], half[second] - 1])
    term = np.concatenate([t[is_start], t[second]])
    key = np.unique(pas * len(x.terms) + term)
    pas, term = key // len(x.terms), key % len(x.terms)
    # 1. term bounds
    bound = np.bincount(pas, weights=x.best[term])
    live = bound[pas] >= threshold
    pas, term = pas[live], term[live]
    if not len(pas):
        return none
    names, local = np.unique(pas, return_inverse=True)
    n_blocks = len(x.rest)
    out = []
    per = max(1, CELLS_AT_ONCE // n_blocks)
    cuts = np.searchsorted(local, np.arange(0, len(names) + per, per))
    for c, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        p, tm = local[i:j] - c * per, term[i:j]
        m = min(per, len(names) - c * per)
        if m <= 0 or i == j:
            continue
        # 2. block bounds
        sel = x.selective[tm]
        sp, st = p[sel], tm[sel]
        which, at = ranges(x.max_at[st], x.max_at[st + 1] - x.max_at[st])
        ub = np.bincount(sp[which] * n_blocks + x.max_block[at], weights=x.max_impact[at], minlength=m * n_blocks)
        other = np.bincount(p[~sel], weights=x.best[tm[~sel]], minlength=m)
        open_ = ub.reshape(m, n_blocks) + np.minimum(x.rest, other[:, None]) >= threshold - 1e-9
        go = open_.any(axis=1)
        keep = go[p]
        p, tm = p[keep], tm[keep]
        # 3. full scores in the open blocks
        which, at = ranges(x.post_at[tm], x.post_at[tm + 1] - x.post_at[tm])
        seg = x.post_segment[at]
        ok = open_[p[which], seg // BLOCK]
        pair, score = np.unique(p[which][ok] * len(x.item) + seg[ok], return_inverse=True)
        score = np.bincount(score, weights=x.post_impact[at][ok], minlength=len(pair))
        good = score >= threshold - 1e-9
        out.append((names[c * per + pair[good] // len(x.item)], pair[good] % len(x.item), score[good]))
    if not out:
        return none
    half, seg, score = (np.concatenate(v) for v in zip(*out))
    row = np.searchsorted(half_at, half, "right") - 1
    key, at = np.unique(row * len(x.item) + seg, return_inverse=True)
    best = np.zeros(len(key))
    np.maximum.at(best, at, score)
    return key // len(x.item), key % len(x.item), best


def leaks(b: Block, x: Index, threshold: float, percent: int) -> list[tuple]:
    """(row, item_id, score, overlap, question_overlap, answer_overlap) of a block's leaks."""
    row, seg, score = retrieve(b, word_hashes(b), x, threshold)
    if not len(row):
        return []
    s_row, s = shingles(b, SHINGLE)
    order = np.argsort(s_row, kind="stable")
    s_row, s = s_row[order], s[order]
    total = np.zeros((len(x.item_ids), 3), np.int64)
    np.add.at(total, (np.repeat(np.arange(len(x.item_ids)), np.diff(x.shingle_at)), x.part), 1)
    out = []
    for r in np.unique(row):
        mine = s[np.searchsorted(s_row, r):np.searchsorted(s_row, r, "right")]
        found: dict[int, float] = {}
        for g, v in zip(seg[row == r], score[row == r]):
            found[int(x.item[g])] = max(found.get(int(x.item[g]), 0.0), float(v))
        for i, v in found.items():
            part = slice(x.shingle_at[i], x.shingle_at[i + 1])
            hits = np.bincount(x.part[part][np.isin(x.shingle[part], mine)], minlength=3)
            if 100 * hits.sum() >= percent * total[i].sum() or (total[i][0] >= QUESTION and 100 * hits[0] >= percent * total[i][0]):
                q, a = (float(hits[k] / total[i][k]) if total[i][k] else 0.0 for k in (0, 1))
                out.append((int(r), x.item_ids[i], v, float(hits.sum() / total[i].sum()), q, a))
    return out


def _index_parts(benchmark: DataFrame, item_col: str, text_col: str, index_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in parts of bounded size, one part in the driver at a time."""
    items = (benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))
             .filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    total = items.agg(F.sum(words)).first()[0] or 0
    parts = int(-(-total // index_words))
    for k in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        part = [(r.item_id, r.text) for r in mine.collect()]
        if part:
            yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, percent: int = PERCENT,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 index_words: int = INDEX_WORDS) -> DataFrame:
    """One row per (document, item) leak: doc_id, item_id, score, overlap, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], MATCH_DDL)
    for part in _index_parts(benchmark, item_col, item_text_col, index_words):
        shared = spark.sparkContext.broadcast(build_index(part))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for b in blocks(x.column(1), lower=True):
                    found = leaks(b, shared.value, threshold, percent)
                    ids = x.column(0).slice(b.first, b.rows).take(pa.array([f[0] for f in found], pa.int64()))
                    rest = {c: [f[k] for f in found] for k, c in enumerate(_MATCH.names) if k}
                    yield columns(_MATCH, doc_id=ids, **rest)

        out = out.unionByName(narrow.mapInArrow(search, MATCH_DDL))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, percent: int = PERCENT,
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      index_words: int = INDEX_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that leak no item."""
    spark = docs.sparkSession
    ship(spark)
    at, out = docs.columns.index(text_col), docs
    for part in _index_parts(benchmark, item_col, item_text_col, index_words):
        shared = spark.sparkContext.broadcast(build_index(part))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in batches:
                keep = np.ones(x.num_rows, bool)
                for b in blocks(x.column(at).cast(pa.string()), lower=True):
                    keep[[b.first + f[0] for f in leaks(b, shared.value, threshold, percent)]] = False
                yield x.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out
