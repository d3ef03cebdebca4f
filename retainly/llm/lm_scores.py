"""Stupid-backoff scores of all documents under a bigram model of the same corpus.

Every word and every bigram has its exact count. The ``VOCABULARY`` most frequent words (ties
by hash) are broadcast with their counts, as a fast way for most of the text; the others find
their counts by hash. A word w after u scores

    log(c(uw) / c(u))              where c(uw) >= ``MIN_COUNT``
    log(BACKOFF * c(w) / N)        else

and the first word of a row log(c(w) / N). The document's score is the sum, its mean the sum
over its words.

1. Words are counted per task, then by hash: one partially aggregated shuffle, written. With them
   go the word pairs that take a large share of a block; the ``COMMON`` most frequent of these are
   the common bigrams.
2. Every document's back-off part is summed where it is read, as if every word outside the
   vocabulary occurred once; a bitmap of the words that occur more often names those to correct.
   The common bigrams are counted there, per task first.
3. What a common bigram adds over its back-off is summed where the document is read. All other
   distinct bigrams of known words of a document go by hash to a bucket (keys of two vocabulary
   numbers, so no collisions), many to a row; a bucket holds about ``BUCKET_ROWS`` of them, is
   counted at once, and what its seen bigrams add is summed by document before and after the
   next shuffle. A pair with a large share of all words has one in some block, so no bucket
   holds such a key.
4. Bigrams with a word outside the vocabulary are counted by their two word hashes. They and
   the corrections of 2 are sums of log counts of single words, so one join by word hash with
   the written counts settles both. No such word has more than 1 / ``VOCABULARY`` of all words.

Defined results: null or word-less text has 0 words, score 0 and a null mean; rows that
share a doc_id are scored as parts of one document (one output row); rows without an id are
counted in the model and give one row with a null id; an empty table gives no rows; only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import id_filter, may_hold, ship, stored
from ._text import Block, blocks, columns, give_back, mix, word_hashes

VOCABULARY = 1 << 18
MIN_COUNT = 2
BACKOFF = 0.4
COMMON = 1 << 15
BLOCK_SHARE = 2000  # a pair that is at least this part of a block's words may be common
CELLS = 1 << 18
BUCKET_ROWS = 1 << 21
LEAST_BUCKETS = 256  # so that a document's sums a bucket are about as many in small tables as in large ones
TASK_WORDS = 2_000_000  # words a task counts before it hands them on


class Vocabulary:
    """The frequent words by number, their counts, and the common bigrams with theirs."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.total = hashes[order], counts[order], total
        self.unknown = len(hashes)
        known = np.append(self.counts, 1)  # any other word, until its count is joined
        self.back = np.log(BACKOFF) + np.log(known) - np.log(max(1, total))
        self.log_count = np.log(known)
        self.cells = np.zeros(CELLS, bool)
        self.common = self.common_total = np.zeros(0, np.int64)

    def set_common(self, u: np.ndarray, w: np.ndarray) -> None:
        nu, nw = self.numbers(u), self.numbers(w)
        ok = (nu != self.unknown) & (nw != self.unknown)
        self.common = np.unique((nu[ok].astype(np.int64) << 32) | nw[ok])
        self.common_total = np.zeros(len(self.common), np.int64)
        self.cells[cell_of(self.common)] = True

    def common_at(self, key: np.ndarray) -> np.ndarray:
        """The keys' places among the common bigrams, -1 for others."""
        at = np.full(len(key), -1)
        maybe = np.flatnonzero(self.cells[cell_of(key)])
        if len(maybe):
            place = np.minimum(np.searchsorted(self.common, key[maybe]), len(self.common) - 1)
            at[maybe] = np.where(self.common[place] == key[maybe], place, -1)
        return at

    def gain(self, key: np.ndarray, times: np.ndarray, total: np.ndarray) -> np.ndarray:
        """What seen bigrams add to their back-off score."""
        return times * (np.log(total) - self.log_count[key >> 32] - self.back[key & 0xFFFFFFFF])

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), self.unknown)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, self.unknown)


def frequent_pairs(b: Block, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, w, n) of word pairs by hash that are at least 1 / ``BLOCK_SHARE`` of the block's words."""
    at = np.flatnonzero(b.doc[1:] == b.doc[:-1])
    least = max(2, len(h) // BLOCK_SHARE)
    cell = cell_of(mix(h[at] * np.uint64(3) + h[at + 1]).view(np.int64))
    at = at[(np.bincount(cell, minlength=CELLS) >= least)[cell]]
    u, w, n = tallied(h[at], h[at + 1])
    often = n >= least
    return u[often], w[often], n[often]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, next, n): every distinct word's count, without a next, and frequent pairs of single blocks; summed inside a task first."""
    schema = pa.schema([("word", pa.int64()), ("next", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for x in batches:
            for b in blocks(x.column(1)):
                h = word_hashes(b)
                held.append(np.unique(h, return_counts=True))
                u, w, n = frequent_pairs(b, h)
                yield columns(schema, word=u.view(np.int64), next=w.view(np.int64), n=n)
                size += len(held[-1][0])
                if size > TASK_WORDS:
                    held, size = [merged(held)], 0
                    if len(held[0][0]) > TASK_WORDS // 2:
                        yield from given(held)
                        held = []
        if held:
            yield from given([merged(held)])

    def merged(held):
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def given(held):
        for k, n in held:
            for i in range(0, len(k), 200_000):
                part = k[i:i + 200_000].view(np.int64)
                yield columns(schema, word=part, next=pa.nulls(len(part)), n=n[i:i + 200_000])

    return docs.mapInArrow(run, "word bigint, next bigint, n bigint").groupBy("word", "next").agg(F.sum("n").alias("n"))


def learn_vocabulary(docs: DataFrame, size: int = VOCABULARY) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary with its common bigrams, and (word, n) of all words."""
    found = stored(word_counts(docs), "words")
    counts = found.filter("next IS NULL").select("word", "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "word").limit(size).toArrow()  # at most ``size`` rows of 16 bytes
    v = Vocabulary(top["word"].to_numpy().view(np.uint64), top["n"].to_numpy(), total)
    pairs = found.filter("next IS NOT NULL").orderBy(F.desc("n"), "word", "next").limit(COMMON).toArrow()
    v.set_common(pairs["word"].to_numpy().view(np.uint64), pairs["next"].to_numpy().view(np.uint64))
    return v, counts


def tallied(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of the key columns, and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return (*(k[first] for k in keys), np.diff(np.append(first, len(order))))


def rare_words(b: Block, v: Vocabulary, held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, which words are in the vocabulary, and which others the filter holds."""
    h = word_hashes(b)
    known = v.numbers(h) != v.unknown
    rare = np.zeros(len(h), bool)
    at = np.flatnonzero(~known)
    rare[at] = may_hold(pa.array(h[at].view(np.int64)), held)
    return h, known, rare


def bigrams(b: Block, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, and the row and key of each bigram of known words."""
    w = v.numbers(word_hashes(b))
    ok = np.flatnonzero((b.doc[1:] == b.doc[:-1]) & (w[1:] != v.unknown) & (w[:-1] != v.unknown))
    return w, b.doc[ok], (w[ok].astype(np.int64) << 32) | w[ok + 1]


def cell_of(key: np.ndarray) -> np.ndarray:
    k = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (k >> np.uint64(46)).astype(np.int64)  # 18 bits, as CELLS


def _base(docs: DataFrame, shared, held) -> DataFrame:
    """Rows (doc_id, n_words, base) of every row, (doc_id, word, seen) of its rare words, then (common, seen) of the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.float64()), ("common", pa.int32()),
                        ("seen", pa.int64()), ("word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        seen = np.zeros(len(v.common) + 1, np.int64)  # the last is for all others
        for x in batches:
            for b in blocks(x.column(1)):
                w, _, key = bigrams(b, v)
                seen += np.bincount(v.common_at(key) % len(seen), minlength=len(seen))
                base = np.bincount(b.doc, weights=v.back[w], minlength=b.rows)
                base = base - np.log(BACKOFF) * (b.counts > 0)  # the first word is not a back-off
                none = pa.nulls(b.rows)
                ids = x.column(0).slice(b.first, b.rows)
                yield columns(schema, doc_id=ids, n_words=b.counts, base=base, common=none, seen=none, word=none)
                h, _, rare = rare_words(b, v, held.value)
                row, word, times = tallied(b.doc[rare], h[rare])
                for i in range(0, len(row), 200_000):
                    t = slice(i, i + 200_000)
                    none = pa.nulls(len(row[t]))
                    yield columns(schema, doc_id=ids.take(pa.array(row[t])), n_words=none, base=none, common=none, seen=times[t],
                                  word=word[t].view(np.int64))
        used = np.flatnonzero(seen[:-1])
        none = pa.nulls(len(used))
        yield columns(schema, doc_id=none, n_words=none, base=none, common=used.astype(np.int32), seen=seen[used], word=none)

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, base double, common int, seen bigint, word bigint")


def planes(a: np.ndarray) -> bytes:
    """The bytes of integers, all first bytes before all second ones: the high ones, mostly equal, compress to little."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _bigram_rows(docs: DataFrame, shared, buckets: int, min_count: int) -> DataFrame:
    """(bucket, doc, valid, key, times) of each row's distinct bigrams, a block's for one bucket in one row; and, with a gain
    instead of key and times, each row's sum over its common bigrams."""
    names = ("doc", "valid", "key", "times", "gain")
    schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        turn = TaskContext.get().partitionId()
        for x in batches:
            for b in blocks(x.column(1)):
                col = x.column(0).slice(b.first, b.rows)
                ids, valid = col.fill_null(0).to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)
                _, row, key = bigrams(b, v)
                at = v.common_at(key)
                hot = np.flatnonzero(at >= 0)
                hot = hot[v.common_total[at[hot]] >= min_count]
                gain = np.bincount(row[hot], weights=v.gain(key[hot], 1, v.common_total[at[hot]]), minlength=b.rows)
                some = np.flatnonzero(np.bincount(row[hot], minlength=b.rows))
                out = [(turn % buckets, planes(np.diff(ids[some], prepend=0)), planes(valid[some]), None, None, gain[some].tobytes())]
                turn += 1
                row, key = row[at < 0], key[at < 0]
                row, key, times = tallied(row, key)
                to = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                ends = np.cumsum(np.bincount(to.astype(np.int64), minlength=buckets))
                row, key, times = row[order], key[order], times[order].astype(np.int32)
                for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
                    t = slice(int(ends[k - 1]) if k else 0, int(ends[k]))
                    out.append((k, planes(np.diff(ids[row[t]], prepend=0)), planes(valid[row[t]]), planes(key[t]), planes(times[t]), None))
                yield columns(schema, **{f.name: list(c) for f, c in zip(schema, zip(*out))})

    return docs.mapInArrow(run, "bucket int, " + ", ".join(f"{n} binary" for n in names))


def _gains(rows: DataFrame, shared, min_count: int) -> DataFrame:
    """Per document, what its seen bigrams add to the back-off score; summed per bucket first."""
    schema = pa.schema([("doc", pa.int64()), ("gain", pa.float64())])

    def summed(doc, valid, gain):
        where, docs_ = pd.factorize(doc[valid])
        yield columns(schema, doc=docs_, gain=np.bincount(where, weights=gain[valid], minlength=len(docs_)))
        if not valid.all():
            yield columns(schema, doc=pa.nulls(1), gain=[gain[~valid].sum()])

    def counted(held):
        v: Vocabulary = shared.value
        doc, valid, key, times = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(times[order], first, dtype=np.int64)
        total = np.repeat(total, np.diff(np.append(first, len(key))))
        take = np.flatnonzero(total >= min_count)
        order = order[take]
        yield from summed(doc[order], valid[order], v.gain(key[take], times[order], total[take]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by bucket: one bucket is held at a time."""
        bucket, held = None, []
        for x in batches:
            for k, doc, valid, key, times, gain in zip(*(x.column(i).to_pylist() for i in range(6))):
                doc, valid = np.cumsum(from_planes(doc, np.int64)), from_planes(valid, bool)
                if gain is not None:
                    yield from summed(doc, valid, np.frombuffer(gain, np.float64))
                    continue
                if k != bucket and held:
                    yield from counted(held)
                    held = []
                bucket = k
                held.append((doc, valid, from_planes(key, np.int64), from_planes(times, np.int32)))
        if held:
            yield from counted(held)
        give_back()

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc bigint, gain double").groupBy("doc").agg(F.sum("gain").alias("gain"))


def _rare_bigrams(docs: DataFrame, shared, held) -> DataFrame:
    """(u, w, doc, times) of each row's distinct bigrams with a word outside the vocabulary, by word hashes."""
    schema = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("doc", pa.int64()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        for x in batches:
            for b in blocks(x.column(1)):
                ids = x.column(0).slice(b.first, b.rows)
                h, known, rare = rare_words(b, v, held.value)
                ok = known | rare
                at = np.flatnonzero((b.doc[1:] == b.doc[:-1]) & ok[1:] & ok[:-1] & (rare[1:] | rare[:-1]))
                row, u, w, times = tallied(b.doc[at], h[at], h[at + 1])
                for i in range(0, len(row), 200_000):
                    t = slice(i, i + 200_000)
                    yield columns(schema, u=u[t].view(np.int64), w=w[t].view(np.int64), doc=ids.take(pa.array(row[t])),
                                  times=times[t].astype(np.int32))

    return docs.mapInArrow(run, "u bigint, w bigint, doc bigint, times int")


def _rare_gains(counted: DataFrame, shared) -> DataFrame:
    """(word, doc, times, gain): a seen bigram's gain, and how often the log count of its words outside the vocabulary counts."""
    schema = pa.schema([("word", pa.int64()), ("doc", pa.int64()), ("times", pa.int64()), ("gain", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        for x in batches:
            u, w, times, total = (x.column(c).to_numpy() for c in ("u", "w", "times", "total"))
            nu, nw = v.numbers(u.view(np.uint64)), v.numbers(w.view(np.uint64))
            gain = times * (np.log(total) - v.log_count[nu] - v.back[nw])
            first, both = nu == v.unknown, np.flatnonzero((nu == v.unknown) & (nw == v.unknown))
            yield columns(schema, word=np.where(first, u, w), doc=x.column("doc"), times=-times.astype(np.int64), gain=gain)
            yield columns(schema, word=w[both], doc=x.column("doc").take(pa.array(both)), times=-times[both].astype(np.int64),
                          gain=np.zeros(len(both)))

    return counted.mapInArrow(run, "word bigint, doc bigint, times bigint, gain double")


def lm_scores(docs: DataFrame, vocabulary: int = VOCABULARY, min_count: int = MIN_COUNT, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One row per doc_id: doc_id, n_words, score, mean_score."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    v, counts = learn_vocabulary(narrow, vocabulary)
    # a word seen once has a log count of 0 and no bigram that is seen twice
    counts = counts.filter(F.col("n") >= min(2, min_count))
    held = id_filter(counts.select("word"), counts.count())
    base = stored(_base(narrow, spark.sparkContext.broadcast(v), held), "base")
    got = base.filter("common IS NOT NULL").groupBy("common").agg(F.sum("seen").alias("seen")).toArrow()  # at most COMMON rows
    v.common_total[got["common"].to_numpy()] = got["seen"].to_numpy()
    shared = spark.sparkContext.broadcast(v)

    buckets = max(LEAST_BUCKETS, -(-v.total // BUCKET_ROWS))
    parts = _gains(_bigram_rows(narrow, shared, buckets, min_count), shared, min_count)
    others = (_rare_bigrams(narrow, shared, held).withColumn("total", F.sum("times").over(Window.partitionBy("u", "w")))
              .filter(F.col("total") >= min_count))
    single = base.filter("word IS NOT NULL").select("word", F.col("doc_id").alias("doc"), F.col("seen").alias("times"),
                                                    F.lit(0.0).alias("gain"))
    exact = single.unionByName(_rare_gains(others, shared)).join(counts, "word")
    parts = parts.unionByName(exact.select("doc", (F.col("gain") + F.col("times") * F.log("n")).alias("gain")))
    gains = parts.groupBy("doc").agg(F.sum("gain").alias("gain"))
    each = (base.filter("n_words IS NOT NULL").groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("base").alias("base")))
    score = F.col("base") + F.coalesce("gain", F.lit(0.0))
    return (each.join(gains, each["doc_id"].eqNullSafe(gains["doc"]), "left")
            .select("doc_id", "n_words", score.alias("score"),
                    F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_score")))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT k, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT k, doc_id, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS u FROM p),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
n AS (SELECT count(*) AS n FROM t),
c2 AS (SELECT u, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, w),
s AS (SELECT t.doc_id, CASE WHEN t.u IS NULL THEN ln(cw.c / n.n) WHEN c2.c >= 2 THEN ln(c2.c / cu.c)
        ELSE ln(0.4 * cw.c / n.n) END AS s
      FROM t JOIN c1 AS cw ON cw.w = t.w LEFT JOIN c1 AS cu ON cu.w = t.u LEFT JOIN c2 ON c2.u = t.u AND c2.w = t.w, n),
g AS (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id)
SELECT x.doc_id, x.n AS n_words, round(coalesce(g.s, 0), 4) AS score,
       CASE WHEN x.n > 0 THEN round(g.s / x.n, 4) END AS mean_score
FROM (SELECT doc_id, sum(len(w))::BIGINT AS n FROM d GROUP BY doc_id) AS x LEFT JOIN g ON g.doc_id = x.doc_id
"""
