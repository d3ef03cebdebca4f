"""Token ids in training order as fixed-stride binary shards.

The ids of all documents, each followed by an end id, form one stream that is cut into
sequences of ``length`` ids; the last one is filled up with the end id. A keyed Feistel
permutation on the smallest even-bit domain that holds the number of sequences, walked in
cycles until it lands inside, gives every sequence a slot of its own: no sort and no random
state, and any slot can be computed alone. Shard s holds the slots [s * records, (s + 1) *
records), so shards are ranges of slots; a record is ``length`` little-endian ids of
``width`` bytes, and record r of a shard starts at byte r * length * width.

1. Documents are encoded once and written with the task's number and the place inside the
   task's stream. That table is the corpus order: written, so no retry can change it.
2. The tasks' totals (one row a task) give every task's place in the whole stream.
3. Documents are cut at sequence borders, dealt by shard, and each shard's records are
   laid out in slot order and written as one row (shard, first slot, records, bytes).

``read_records`` starts anywhere: it reads whole shards and skips to the slot.

Defined results: a null or empty text is the end id alone; an empty table gives no shards;
repeated rows are encoded as often as they occur; only the named columns are read. Ids that
do not fit ``width`` raise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import folder, ship, stored
from ._text import blocks, columns, mix
from ._tok import coder, encode_texts, words_apart

LENGTH = 2048
RECORDS = 1024
WIDTH = 2
SHARDS_PER_FILE = 8  # a reader holds the shards of a file at a time
ROUNDS = 6
KEY = 0x5EED


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, (max(n, 2) - 1).bit_length()) // 2)))
        self.low = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _turn(self, v: np.ndarray, back: bool) -> np.ndarray:
        left, right = v >> self.half, v & self.low
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mix(left ^ k) & self.low), left
            else:
                left, right = right, left ^ (mix(right ^ k) & self.low)
        return (left << self.half) | right

    def _walk(self, v: np.ndarray, back: bool) -> np.ndarray:
        v = self._turn(np.asarray(v).astype(np.uint64), back)
        out = np.flatnonzero(v >= self.n)
        while len(out):  # the walk stays on the start's cycle, so it ends inside
            v[out] = self._turn(v[out], back)
            out = out[v[out] >= self.n]
        return v.astype(np.int64)

    def slot(self, sequence) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot) -> np.ndarray:
        return self._walk(slot, True)


def encoded(docs: DataFrame, path: str, end_id: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Stored rows (task, place, n, ids): runs of documents in stream order, at most one block each."""
    dtype = {2: "<u2", 4: "<u4"}[width]
    apart = words_apart(path)
    schema = pa.schema([("task", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        for x in batches:
            for b in blocks(x.column(0), max_bytes=1 << 20):
                if apart:
                    ids, off = coder(path).encode(b)
                else:
                    lists = encode_texts(path, [b.data[i:j].tobytes().decode() for i, j in zip(b.offsets[:-1], b.offsets[1:])])
                    off = np.concatenate([[0], np.cumsum([len(v) for v in lists])]).astype(np.int64)
                    ids = np.array([i for v in lists for i in v], np.uint32)
                full = np.insert(ids, off[1:], end_id)
                if len(full) and int(full.max()) >= 1 << (8 * width):
                    raise ValueError(f"id {int(full.max())} does not fit {width} bytes")
                yield columns(schema, task=[task], place=[place], n=[len(full)], ids=[full.astype(dtype).tobytes()])
                place += len(full)

    narrow = docs.select(F.col(text_col).cast("string").alias("text"))
    return stored(narrow.mapInArrow(run, "task bigint, place bigint, n bigint, ids binary"), "ids", "zstd")


def write_shards(docs: DataFrame, path: str, out: str, length: int = LENGTH, records: int = RECORDS, key: int = KEY,
                 end_id: int = 0, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write the shards as Parquet rows (shard, first_slot, n_records, content) under ``out``; returns the sequences."""
    spark = docs.sparkSession
    ship(spark)
    ids = encoded(docs, path, end_id, width, id_col, text_col)
    totals = ids.groupBy("task").agg(F.sum("n").alias("n")).orderBy("task").toArrow()  # one row a task
    task, n = totals["task"].to_numpy(), totals["n"].to_numpy()
    total = int(n.sum())
    n_seq = -(-total // length)
    base = spark.sparkContext.broadcast((task, np.cumsum(n) - n))
    order = spark.sparkContext.broadcast(Feistel(max(1, n_seq), key))
    piece = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("offset", pa.int32()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks, places = base.value
        for x in batches:
            for t, p, m, raw in zip(*(x.column(i).to_pylist() for i in range(4))):
                first = int(places[np.searchsorted(tasks, t)]) + p
                edges = np.unique(np.r_[first, np.arange(-(-first // length) * length, first + m, length), first + m])
                begin = edges[:-1]
                slot = order.value.slot(begin // length)
                parts = [raw[(i - first) * width:(j - first) * width] for i, j in zip(begin.tolist(), edges[1:].tolist())]
                yield columns(piece, shard=slot // records, slot=slot, offset=(begin % length).astype(np.int32), ids=parts)

    made = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_records", pa.int64()), ("content", pa.binary())])

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records arrive in slot order: one shard's bytes are held at a time."""
        fill = int(end_id).to_bytes(width, "little")
        shard, slot, rows, buf, got = None, -1, 0, bytearray(), 0

        def finish():
            buf.extend(fill * (rows * length - got))
            return columns(made, shard=[shard], first_slot=[shard * records], n_records=[rows], content=[bytes(buf)])

        for x in batches:
            for s, at, _, raw in zip(*(x.column(i).to_pylist() for i in range(4))):
                if s != shard:
                    if shard is not None:
                        yield finish()
                    shard, slot, rows, buf, got = s, -1, 0, bytearray(), 0
                if at != slot:
                    short = rows * length - got  # only the stream's last sequence ends early
                    buf.extend(fill * short)
                    got += short
                    slot, rows = at, rows + 1
                buf.extend(raw)
                got += len(raw) // width
        if shard is not None:
            yield finish()

    pieces = ids.mapInArrow(cut, "shard bigint, slot bigint, offset int, ids binary")
    dealt = pieces.repartition("shard").sortWithinPartitions("shard", "slot", "offset")
    dealt.mapInArrow(lay_out, "shard bigint, first_slot bigint, n_records bigint, content binary").write.option(
        "maxRecordsPerFile", SHARDS_PER_FILE).option("compression", "zstd").parquet(out)
    return n_seq


def _each_record(spark: SparkSession, out: str, start: int, stop: int | None, length: int, width: int, ddl: str, make) -> DataFrame:
    """``make(slots, shard, records, list of bytes)`` of every shard's part of the slots [start, stop), as one frame."""
    shards = spark.read.parquet(out).filter(F.col("first_slot") + F.col("n_records") > start)
    if stop is not None:
        shards = shards.filter(F.col("first_slot") < stop)
    stride = length * width

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                shard, first, n = (x.column(c)[i].as_py() for c in ("shard", "first_slot", "n_records"))
                content = x.column("content")[i].as_buffer()
                r = np.arange(max(0, start - first), n if stop is None else min(n, stop - first))
                yield make(first + r, shard, r, [content.slice(k * stride, stride).to_pybytes() for k in r.tolist()])

    return shards.select("shard", "first_slot", "n_records", "content").mapInArrow(records, ddl)


def read_records(spark: SparkSession, out: str, start: int = 0, stop: int | None = None, length: int = LENGTH,
                 width: int = WIDTH) -> DataFrame:
    """(slot, shard, record, ids) of the slots [start, stop), each record cut from its shard by its stride."""
    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("record", pa.int64()), ("ids", pa.binary())])

    def make(slot, shard, record, raw):
        return columns(schema, slot=slot, shard=np.full(len(slot), shard), record=record, ids=raw)

    return _each_record(spark, out, start, stop, length, width, "slot bigint, shard bigint, record bigint, ids binary", make)


def shard_digests(docs: DataFrame, path: str, length: int = LENGTH, records: int = RECORDS, key: int = KEY, end_id: int = 0,
                  width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to the shared folder and return per record: slot, shard, record, sequence_id, n_ends, ids_crc32."""
    spark = docs.sparkSession
    out = folder(spark, "shards")
    n_seq = write_shards(docs, path, out, length, records, key, end_id, width, id_col, text_col)
    order = spark.sparkContext.broadcast(Feistel(max(1, n_seq), key))
    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("record", pa.int64()), ("sequence_id", pa.int64()),
                        ("n_ends", pa.int64()), ("ids_crc32", pa.int64())])
    dtype = {2: "<u2", 4: "<u4"}[width]

    def make(slot, shard, record, raw):
        return columns(schema, slot=slot, shard=np.full(len(slot), shard), record=record, sequence_id=order.value.sequence(slot),
                       n_ends=[int((np.frombuffer(v, dtype) == end_id).sum()) for v in raw], ids_crc32=[zlib.crc32(v) for v in raw])

    return _each_record(spark, out, 0, None, length, width,
                        "slot bigint, shard bigint, record bigint, sequence_id bigint, n_ends bigint, ids_crc32 bigint", make)
