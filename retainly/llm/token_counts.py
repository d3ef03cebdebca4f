"""Token counts of whole texts, huge documents by overlapping chunks.

Texts up to ``huge_bytes`` are encoded whole. A longer one is cut into chunks of
``chunk_chars`` that overlap by ``overlap`` characters; each chunk is encoded on its
own with offsets. Two neighbours are spliced at the first common stable boundary of
their overlap: a token start beside white space where both encodings agree on that
start and on the next ``RUN`` tokens. Where no such boundary exists the document is
cut anew with an overlap ``WIDEN`` times wider, in the end as one chunk, so the count
is always that of the whole text.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows are
counted and returned as often as they occur; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ship, stored
from ._text import blocks, columns
from ._tok import coder, encode_texts, load, words_apart

LIMIT = 2048
HUGE_BYTES = 65_536
CHUNK_CHARS = 32_768
OVERLAP = 512
WIDEN = 16
RUN = 4
_WHITE = " \t\n\v\f\r"

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_EDGE = pa.list_(pa.int64())
_CHUNK = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("n_bytes", pa.int64()), ("copies", pa.int64()),
                    ("chunk", pa.int64()), ("n_tokens", pa.int64()), ("last", pa.bool_()),
                    ("head_at", _EDGE), ("head_id", _EDGE), ("head_ok", pa.list_(pa.bool_())),
                    ("tail_at", _EDGE), ("tail_id", _EDGE)])
_CHUNK_DDL = ("doc_id bigint, key string, n_bytes bigint, copies bigint, chunk bigint, n_tokens bigint, last boolean, "
              "head_at array<bigint>, head_id array<bigint>, head_ok array<boolean>, tail_at array<bigint>, tail_id array<bigint>")


def batch_counts(path: str, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of every text of an Arrow column."""
    apart = words_apart(path)
    n_bytes, n_tokens = [], []
    for b in blocks(col):
        n_bytes.append(np.diff(b.offsets))
        if apart:
            n_tokens.append(coder(path).counts(b))
        else:
            texts = [b.data[i:j].tobytes().decode() for i, j in zip(b.offsets[:-1], b.offsets[1:])]
            n_tokens.append(np.array([len(x) for x in encode_texts(path, texts)], np.int64))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(n_bytes or none), np.concatenate(n_tokens or none)


def encode_with_starts(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text and the character where each token starts."""
    tok = load(path)
    if path.endswith(".model"):
        e = tok.encode(text, out_type="offset_mapping")
        return np.array(e["ids"], np.int64), np.array([o[0] for o in e["offsets"]], np.int64)
    e = tok.encode(text, add_special_tokens=False)
    return np.array(e.ids, np.int64), np.array([o[0] for o in e.offsets], np.int64)


def beside_white(text: str, at: int) -> bool:
    return 0 < at < len(text) and (text[at - 1] in _WHITE) != (text[at] in _WHITE)


def splice(head_at, head_id, head_ok, tail_at, tail_id) -> int | None:
    """Tokens to take off two neighbours' summed counts, or None where no stable boundary is common.

    ``head`` is the start of the right chunk, ``tail`` the end of the left one, both over the overlap.
    """
    place = {int(p): i for i, p in enumerate(tail_at)}
    for i in range(len(head_at) - RUN):
        j = place.get(int(head_at[i]))
        if (head_ok[i] and j is not None and j + RUN < len(tail_at)
                and list(head_at[i:i + RUN + 1]) == list(tail_at[j:j + RUN + 1])
                and list(head_id[i:i + RUN]) == list(tail_id[j:j + RUN])):
            return (len(tail_at) - j) + i
    return None


def _same(left: DataFrame, right: DataFrame, *cols: str, how: str = "inner") -> DataFrame:
    """Join on ``cols`` and doc_id, where two missing ids are equal; the left side's key columns stay."""
    named = right.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", *cols)})
    on = left["doc_id"].eqNullSafe(named["_doc_id"])
    for c in cols:
        on = on & (left[c] == named[f"_{c}"])
    return left.join(named, on, how).drop(*(f"_{c}" for c in ("doc_id", *cols)))


def _encode_huge(docs: DataFrame, path: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Rows of (doc_id, key, n_bytes, copies, n_tokens or null where a splice failed)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()),
                            ("at", pa.int64()), ("n_bytes", pa.int64()), ("copies", pa.int64()), ("piece", pa.string())])
        for x in batches:
            for doc_id, key, n_bytes, copies, text in zip(*(x.column(i).to_pylist() for i in range(5))):
                begins = range(0, max(1, len(text) - overlap), chunk_chars)
                for k, s in enumerate(begins):
                    last = k == len(begins) - 1
                    piece = text[s:] if last else text[s:s + chunk_chars + overlap]
                    yield columns(schema, doc_id=[doc_id], key=[key], chunk=[k], last=[last], at=[s],
                                  n_bytes=[n_bytes], copies=[copies], piece=[piece])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                ids, at = encode_with_starts(path, r["piece"])
                h = int(np.searchsorted(at, overlap)) if r["chunk"] else 0
                t = len(at) if r["last"] else int(np.searchsorted(at, chunk_chars))
                yield columns(_CHUNK, **{k: [r[k]] for k in ("doc_id", "key", "n_bytes", "copies", "chunk", "last")},
                              n_tokens=[len(ids)], head_at=[at[:h] + r["at"]], head_id=[ids[:h]],
                              head_ok=[[beside_white(r["piece"], int(p)) for p in at[:h]]],
                              tail_at=[at[t:] + r["at"]], tail_id=[ids[t:]])

    chunks = docs.mapInArrow(cut, "doc_id bigint, key string, chunk bigint, last boolean, at bigint, n_bytes bigint, "
                                  "copies bigint, piece string")
    chunks = stored(chunks.repartition("doc_id", "key", "chunk").mapInArrow(encode, _CHUNK_DDL), "chunks")
    left = chunks.filter(~F.col("last")).select("doc_id", "key", (F.col("chunk") + 1).alias("chunk"), "tail_at", "tail_id")
    right = chunks.filter("chunk > 0").select("doc_id", "key", "chunk", "head_at", "head_id", "head_ok")

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("shared", pa.int64())])
        for x in batches:
            rows = x.to_pylist()
            yield columns(schema, doc_id=[r["doc_id"] for r in rows], key=[r["key"] for r in rows],
                          shared=[splice(r["head_at"], r["head_id"], r["head_ok"], r["tail_at"], r["tail_id"]) for r in rows])

    edges = (_same(left, right, "key", "chunk").mapInArrow(join_edges, "doc_id bigint, key string, shared bigint")
             .groupBy("doc_id", "key").agg(F.sum("shared").alias("shared"), F.count_if(F.col("shared").isNull()).alias("failed")))
    whole = chunks.groupBy("doc_id", "key", "n_bytes", "copies").agg(F.sum("n_tokens").alias("n"))
    return _same(whole, edges, "key", how="left").select(
        "doc_id", "key", "n_bytes", "copies",
        F.when(F.coalesce("failed", F.lit(0)) == 0, F.col("n") - F.coalesce("shared", F.lit(0))).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text",
                 huge_bytes: int = HUGE_BYTES, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n_bytes, n_tokens = batch_counts(path, x.column(1))
            yield columns(_OUT, doc_id=x.column(0), n_bytes=n_bytes, n_tokens=n_tokens)

    small = narrow.filter(F.octet_length("text") <= huge_bytes).mapInArrow(
        count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    # equal rows are encoded once; the group key is the text's digest, so a group holds copies of one text
    huge = (narrow.filter(F.octet_length("text") > huge_bytes)
            .groupBy("doc_id", F.sha2("text", 256).alias("key"))
            .agg(F.first(F.octet_length("text")).cast("bigint").alias("n_bytes"), F.count(F.lit(1)).alias("copies"),
                 F.first("text").alias("text")))
    done, wider = [], overlap
    todo = huge
    while True:
        got = stored(_encode_huge(todo, path, max(chunk_chars, wider), wider), "huge")
        done.append(got.filter("n_tokens IS NOT NULL"))
        failed = got.filter("n_tokens IS NULL").select("doc_id", "key")
        if failed.isEmpty():
            break
        wider *= WIDEN
        todo = _same(huge, failed, "key", how="left_semi")
    out = small
    for d in done:
        out = out.unionByName(d.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("_c"))
                              .drop("_c"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
