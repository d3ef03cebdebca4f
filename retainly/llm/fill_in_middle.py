"""Fill-in-middle transformation with a boundary set in array, bitmap and run containers.

The boundaries of a text are the byte positions where a code point begins. They are held
as a two-level set: positions are dealt by their upper bits to containers of ``CHUNK``
positions, and each container takes the smallest of three forms:

* run: (first, length) pairs; one run where the text is ASCII,
* bitmap: ``CHUNK`` bits, with the count of set bits before every 64-bit word,
* array: the sorted lower 16 bits; where boundaries are few.

Beside them the set keeps cumulative cardinalities. ``select(k)``, the byte position of the
k-th code point, is a search for the container in the cumulative cardinalities, then a
select inside it: an index, a search over the word counts and one word, or a search over
the runs. Both cuts of a document are one ``select`` each; no code point is made a Python
object and the text is cut as bytes.

A document of n code points takes h1 to h4, the first four 8-digit groups of the hex
sha256 of ``1:`` and the decimal id. The prefix ends after the smaller of h1 % (n+1) and
h2 % (n+1) units, the middle after the larger. The form is plain if the text is empty or
contains a sentinel, or if h3 % 100 >= ``100 * rate``; otherwise spm if h4 % 100 < ``100 * spm``,
else psm:

    plain   text
    psm     <P> prefix <S> suffix <M> middle
    spm     <S> suffix <P> prefix <M> middle

Defined results: a null text is empty (n 0, plain); a null id hashes as ``1:`` alone; equal
rows give equal rows; an empty table gives no rows; only the named columns are read, other
columns do not pass. A text with lone surrogates cannot reach Arrow and is no case here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ship
from ._text import columns, string_parts

CHUNK = 1 << 16
P, S, M = b"<P>", b"<S>", b"<M>"
RATE, SPM = 90, 20  # percent
OUT_BYTES = 1 << 20  # of output texts in one Arrow batch

_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                  ("middle_chars", pa.int64()), ("output", pa.large_string())])
_DDL = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
_DIGEST_DDL = ("doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, "
               "restored_sha256 string")


@dataclass
class ArrayContainer:
    low: np.ndarray  # uint16, sorted

    def __len__(self) -> int:
        return len(self.low)

    def select(self, k: int) -> int:
        return int(self.low[k])


@dataclass
class BitmapContainer:
    words: np.ndarray  # uint64
    before: np.ndarray  # set bits before each word, and their total

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[w])
        for _ in range(k - int(self.before[w])):
            word &= word - 1
        return 64 * w + (word & -word).bit_length() - 1


@dataclass
class RunContainer:
    first: np.ndarray
    before: np.ndarray  # positions before each run, and their total

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[r]) + k - int(self.before[r])


def container(inside: np.ndarray):
    """The smallest container of the positions that are set in ``inside`` (at most ``CHUNK`` flags)."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    first, end = edge[::2], edge[1::2]
    size = int((end - first).sum())
    as_runs, as_array, as_bitmap = 4 * len(first), 2 * size, CHUNK // 8
    if as_runs <= min(as_array, as_bitmap):
        return RunContainer(first, np.concatenate([[0], np.cumsum(end - first)]))
    if as_array <= as_bitmap:
        return ArrayContainer(np.flatnonzero(inside).astype(np.uint16))
    packed = np.packbits(inside, bitorder="little")
    words = np.zeros(-(-len(packed) // 8), "<u8")
    words.view(np.uint8)[:len(packed)] = packed
    return BitmapContainer(words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))


class BoundarySet:
    """Where the code points of UTF-8 bytes begin."""

    def __init__(self, data: np.ndarray):
        self.bytes = len(data)
        self.containers = [container((data[i:i + CHUNK] & 0xC0) != 0x80) for i in range(0, len(data), CHUNK)]
        self.before = np.concatenate([[0], np.cumsum([len(c) for c in self.containers], dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The byte where code point ``k`` begins; the end of the text for k = number of code points."""
        if not 0 <= k <= len(self):
            raise IndexError(k)
        if k == len(self):
            return self.bytes
        c = int(np.searchsorted(self.before, k, "right")) - 1
        return c * CHUNK + self.containers[c].select(k - int(self.before[c]))


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(d[8 * i:8 * i + 8], 16) for i in range(4))


def transform(text: bytes, doc_id: int | None, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, prefix and middle length in code points, output) of one text."""
    at = BoundarySet(np.frombuffer(text, np.uint8))
    n = len(at)
    h1, h2, h3, h4 = draws(doc_id)
    if n == 0 or h3 % 100 >= rate or P in text or S in text or M in text:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = at.select(lo), at.select(hi)
    if h4 % 100 < spm:
        return n, "spm", lo, hi - lo, b"".join((S, text[j:], P, text[:i], M, text[i:j]))
    return n, "psm", lo, hi - lo, b"".join((P, text[:i], S, text[j:], M, text[i:j]))


def restore(output: bytes, form: str) -> bytes:
    """The text again, from the output and its form alone: no part holds a sentinel, so each is found where it first occurs."""
    if form == "plain":
        return output
    first, second = (P, S) if form == "psm" else (S, P)
    if not output.startswith(first):
        raise ValueError(f"no {form} output")
    a, rest = output[len(first):].split(second, 1)
    b, middle = rest.split(M, 1)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def _rows(x: pa.RecordBatch, rate: int, spm: int) -> Iterator[tuple]:
    data, off = string_parts(x.column(1))
    for k, doc_id in enumerate(x.column(0).to_pylist()):
        yield doc_id, *transform(data[off[k]:off[k + 1]].tobytes(), doc_id, rate, spm)


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output (the transformed text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            held, size = [], 0
            for row in _rows(x, rate, spm):
                held.append((*row[:5], row[5].decode("utf-8")))
                size += len(row[5])
                if size > OUT_BYTES:
                    yield _batch(_OUT, held)
                    held, size = [], 0
            yield _batch(_OUT, held)

    return _narrow(docs, id_col, text_col).mapInArrow(run, _DDL)


def fim_digests(docs: DataFrame, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fill_in_middle`` with SHA-256 of the output and of the text restored from it in place of the output."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            held = []
            for *row, output in _rows(x, rate, spm):
                back = restore(output, row[2])
                held.append((*row, hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield _batch(_DIGEST, held)

    return _narrow(docs, id_col, text_col).mapInArrow(run, _DIGEST_DDL)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return columns(schema, **{f.name: list(c) for f, c in zip(schema, cols)})
