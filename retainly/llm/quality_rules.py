"""Quality rules with a verdict per host.

Every document gets base counts over its whole text. Failures are summed by host
(``source``), the hosts' failure rates are shrunk with a beta prior fitted to all
hosts by moments, and a host whose shrunk rate exceeds ``host_limit`` takes its
remaining documents with it.

Defined results: null or empty text has no words (base_failed, not kept); a
document without a host is judged by its own counts alone and leaves the prior
untouched; repeated rows are counted and returned as often as they occur; with no
host, one host, or hosts that all fail alike the prior is the weak
Beta(rate, 1 - rate) around the common rate. Only the named columns are read, so
further columns with any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ship, stored
from ._text import blocks, columns, keyed, marked, slice_hashes, spans, windows, word_hashes

MIN_WORDS = 50
REPEAT_PERCENT = 50
HOST_LIMIT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """The five base counts of every text of an Arrow column."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for b in blocks(col):
        body = b.data[:len(b.data) - 8]
        out["n_words"].append(b.counts)
        in_words = np.bincount(b.doc, weights=b.ends - b.starts, minlength=b.rows).astype(np.int64)
        out["word_chars"].append(in_words - marked((body & 0xC0) == 0x80, b.offsets))
        out["n_symbols"].append(marked(_SYMBOL[body], b.offsets))
        out["n_dup_lines"].append(duplicate_lines(b, body))
        out["n_repeat_words"].append(repeated_words(b))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def duplicate_lines(b, body: np.ndarray) -> np.ndarray:
    """Lines holding a word that equal an earlier line of the document."""
    starts, ends = spans(body != 0x0A, b.offsets)
    if len(starts) == 0:
        return np.zeros(b.rows, np.int64)
    has_word = np.searchsorted(b.starts, ends, "left") > np.searchsorted(b.starts, starts, "left")
    starts, ends = starts[has_word], ends[has_word]
    doc = np.searchsorted(b.offsets, starts, "right") - 1
    seen = pd.Series(keyed(slice_hashes(b.data, starts, ends), doc)).duplicated().to_numpy()
    return np.bincount(doc[seen], minlength=b.rows)


def repeated_words(b) -> np.ndarray:
    """Words inside a 3-word window whose sequence occurs at least twice in the document."""
    at, h = windows(word_hashes(b), b.doc, 3)
    if len(at) == 0:
        return np.zeros(b.rows, np.int64)
    codes, _ = pd.factorize(keyed(h, b.doc[at]).view(np.int64))
    hit = at[np.bincount(codes)[codes] >= 2]
    mark = np.zeros(len(b.starts), bool)
    for j in range(3):
        mark[hit + j] = True
    return np.bincount(b.doc[mark], minlength=b.rows)


def base_failures(counts: dict[str, np.ndarray], min_words: int, repeat_percent: int) -> np.ndarray:
    n = counts["n_words"]
    return (n < min_words) | (100 * counts["n_repeat_words"] > repeat_percent * n)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((k, pa.int64()) for k in COUNTS),
                     ("base_failed", pa.bool_())])
_DIGEST_DDL = "doc_id bigint, host string, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", base_failed boolean"


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                    min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> DataFrame:
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            c = text_counts(x.column(2))
            yield columns(_DIGEST, doc_id=x.column(0), host=x.column(1), **c,
                          base_failed=base_failures(c, min_words, repeat_percent))

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                         F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(count, _DIGEST_DDL)


def host_verdicts(counts: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, rejected) from rows of (host, base_failed).

    Moments over hosts: m and v are mean and population variance of the raw rates; the
    prior weight is m(1-m)/v - 1, at least 1 (v = 0 gives weight 1).
    """
    hosts = (counts.filter(F.col("host").isNotNull()).groupBy("host")
             .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()  # one row, whatever the number of hosts
    weight = max(1.0, m * (1 - m) / v - 1) if m is not None and v else 1.0
    prior = (m or 0.0) * weight
    shrunk = (F.col("n_failed") + F.lit(prior)) / (F.col("n_docs") + F.lit(weight))
    return (hosts.withColumn("shrunk_rate", shrunk)
            .withColumn("rejected", F.col("shrunk_rate") > F.lit(float(host_limit))))


def quality_rules(docs: DataFrame, host_limit: float = HOST_LIMIT, **columns_and_limits) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept, host_rate."""
    counts = stored(document_counts(docs, **columns_and_limits), "quality")
    # written first: the planner then knows its size and deals the documents by host only if it is too large to broadcast
    verdicts = stored(host_verdicts(counts, host_limit).select("host", F.col("shrunk_rate").alias("host_rate"), "rejected"), "hosts")
    return (counts.join(verdicts, "host", "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("rejected"), F.lit(False)))
            .select("doc_id", *COUNTS, "base_failed", "kept", "host_rate"))


def keep_good(docs: DataFrame, host_limit: float = HOST_LIMIT, id_col: str = "doc_id", text_col: str = "text",
              host_col: str = "source", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that the rules keep."""
    counts = stored(document_counts(docs, id_col, text_col, host_col, min_words, repeat_percent)
                    .select("host", "base_failed"), "quality")
    bad = stored(host_verdicts(counts, host_limit).filter("rejected").select("host"), "hosts")
    at = docs.columns.index(text_col)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            failed = base_failures(text_counts(x.column(at).cast(pa.string())), min_words, repeat_percent)
            yield x.filter(pa.array(~failed))

    good = docs.mapInArrow(passing, docs.schema)
    return good.join(bad, good[host_col].cast("string") == bad["host"], "left_anti")


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
tri AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM tri) WHERE c >= 2),
cov AS (SELECT k, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
lin AS (SELECT k, count(*) - count(DISTINCT l) AS n
        FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM w)
        WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
c AS (
  SELECT w.k, doc_id, source, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lin.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lin ON lin.k = w.k LEFT JOIN cov ON cov.k = w.k),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS x FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(x / n) AS m, CASE WHEN var_pop(x / n) > 0
        THEN greatest(1.0, avg(x / n) * (1 - avg(x / n)) / var_pop(x / n) - 1) ELSE 1.0 END AS s FROM h),
v AS (SELECT source, (x + m * s) / (n + s) AS host_rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_rate > 0.5, false) AS kept, round(host_rate, 9) AS host_rate
FROM f LEFT JOIN v ON v.source = f.source
"""
