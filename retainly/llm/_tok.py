"""Token ids of whole texts with a public tokenizer file.

``load`` returns the library's tokenizer for a ``.json`` or ``.model`` file, once per
Python process. ``WordCoder`` serves tokenizers that drop white space before merging
(``words_apart``): there the ids of a text are the ids of its words in order, so a
block's distinct words, less their marks and case, are encoded once and the ids are laid out
with numpy. Its memo is bounded; past the bound it starts anew, which changes speed and nothing else.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd

from ._text import Block, slice_hashes, spans, word_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMO_WORDS = 400_000
MEMO_PARTS = 150_000
_LOADED: dict[str, object] = {}
# ASCII marks, Latin letters, ASCII marks: no pre-token crosses these borders (an apostrophe
# before letters may, so it never ends the first part); all letters are precomposed
_PARTS = re.compile(r"([!-&(-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-@\[-`{-~]*)")
# bytes of a block: ASCII letters, other visible ASCII, white space; 4 is all else, and what may join with letters or be special
_LETTER, _MARK = 1, 2
_KIND = np.full(256, 4, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[ord("'"), ord("|")]] = 4
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Units:
    """Byte slices whose ids, one after the other, are those of the block's words: runs of letters (lower-case here), the
    marks before and after such a run, and all other words as they are."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    letters: np.ndarray
    lower: np.ndarray
    hashes: np.ndarray


def units(b: Block, apart: bool) -> Units:
    """The block's words; with ``apart``, words of one run of letters between marks are taken apart."""
    n = len(b.starts)
    if not n or not apart:
        return Units(b.starts, b.ends, b.doc, np.zeros(n, bool), b.data, word_hashes(b))
    size = int(b.offsets[-1])
    kinds = _KIND[b.data]
    held = np.bitwise_or.reduceat(kinds[:size], b.starts)  # a word and the white space after it
    letters = held == _LETTER
    first, last = b.starts.copy(), b.ends.copy()
    mixed = np.flatnonzero(held == _LETTER | _MARK)
    if len(mixed):
        begin, end = spans(kinds[:size] == _LETTER, b.offsets)
        run = np.searchsorted(begin, b.starts[mixed])
        one = np.append(begin, size)[run + 1] >= b.ends[mixed]
        mixed, run = mixed[one], run[one]
        first[mixed], last[mixed] = begin[run], end[run]
        letters[mixed] = True
    starts = np.stack([b.starts, first, last], 1).ravel()
    ends = np.stack([first, last, b.ends], 1).ravel()
    take = np.flatnonzero(ends > starts)
    starts, ends = starts[take], ends[take]
    letters = letters[take // 3] & (take % 3 == 1)
    lower = _LOWER[b.data]
    h = np.empty(len(take), np.uint64)
    h[letters] = slice_hashes(lower, starts[letters], ends[letters])
    h[~letters] = slice_hashes(b.data, starts[~letters], ends[~letters])
    return Units(starts, ends, b.doc[take // 3], letters, lower, h)


def lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """ASCII slices without line ends, as strings."""
    size = ends - starts
    end = np.cumsum(size + 1)
    out = np.empty(int(end[-1]), np.uint8)
    out[end - 1] = 10
    body = np.ones(len(out), bool)
    body[end - 1] = False
    out[body] = data[np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)]
    return out.tobytes().decode("ascii").split("\n")[:-1]


def load(path: str):
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece
            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _LOADED[path] = tok
    return _LOADED[path]


def words_apart(path: str) -> bool:
    """Whether the tokenizer removes white space between pre-tokens (so words are encoded independently)."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    s = steps[0]
    return (s.get("type") == "Split" and s.get("invert") is True and s.get("behavior") == "Removed"
            and r"^\s" in s.get("pattern", {}).get("Regex", "").replace("[", ""))


def encode_texts(path: str, texts: list[str]) -> list[list[int]]:
    """The library's ids of whole texts, without begin, end or added special tokens."""
    tok = load(path)
    if path.endswith(".model"):
        return tok.encode(texts, num_threads=1)
    return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(keep))
    return out


_BYTE_LETTER = _byte_letters()


class WordCoder:
    """Ids of the words of blocks, for a tokenizer with ``words_apart``."""

    def __init__(self, path: str):
        self.path, self.tok = path, load(path)
        self.direct = self._direct_is_exact()
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)      # sorted hashes of units
        self.rows = np.zeros(0, np.int64)       # their row in ``start``
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.parts: dict[str, bytes] = {"": b""}

    def _letters(self, stem: str) -> list[int]:
        s = stem if stem.isascii() else "".join(_BYTE_LETTER[b] for b in stem.encode())
        return [t.id for t in self.tok.model.tokenize(s)]

    def _direct_is_exact(self) -> bool:
        """Letters may go to the model directly if that equals the whole tokenizer on a probe of all letters."""
        probe = ["abcdefghijklm", "nopqrstuvwxyz", "the", "a", "strasse", "".join(map(chr, range(0xDF, 0xF7))),
                 "".join(map(chr, range(0xF8, 0x100))), "été", "über"]
        whole = [e.ids for e in self.tok.encode_batch_fast(probe + [p.upper() for p in probe if p.isascii()], add_special_tokens=False)]
        return whole[:len(probe)] == [self._letters(p) for p in probe] and whole[len(probe):] == [self._letters(p) for p in probe if p.isascii()]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word as 32-bit integers."""
        parts, cut, unknown = self.parts, [], set()
        if len(parts) > MEMO_PARTS:
            parts = self.parts = {"": b""}
        for w in words:
            m = _PARTS.fullmatch(w) if self.direct else None
            c = (m[1], m[2].lower(), m[3]) if m and "<|" not in w else (w,)
            cut.append(c)
            if len(c) == 3 and c[1] not in parts:
                parts[c[1]] = array("I", self._letters(c[1])).tobytes()
            unknown.update(p for p in c if p not in parts)
        todo = list(unknown)
        for p, ids in zip(todo, encode_texts(self.path, todo) if todo else ()):
            parts[p] = array("I", ids).tobytes()
        return [parts[c[0]] if len(c) == 1 else parts[c[0]] + parts[c[1]] + parts[c[2]] for c in cut]

    def _encode(self, b: Block, u: Units, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, sizes, ids): ids of the units ``at[order]``, one after the other, and how many each has."""
        order = np.argsort(~u.letters[at], kind="stable")
        n = int(u.letters[at].sum())
        runs, others = at[order[:n]], at[order[n:]]
        sizes, ids, tokenize = [], [], self.tok.model.tokenize
        for s in lines(u.lower, u.starts[runs], u.ends[runs]) if n else ():
            got = [t.id for t in tokenize(s)]
            sizes.append(len(got))
            ids += got
        each = self._word_ids([b.data[u.starts[k]:u.ends[k]].tobytes().decode("utf-8", "surrogatepass") for k in others])
        sizes += [len(v) // 4 for v in each]
        return order, np.array(sizes, np.int64), np.concatenate([np.array(ids, np.uint32), np.frombuffer(b"".join(each), np.uint32)])

    def rows_of(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """For each unit of the block, its row in the memo and its document."""
        u = units(b, self.direct)
        codes, seen = pd.factorize(u.hashes.view(np.int64))
        seen = seen.view(np.uint64)
        if len(self.keys) + len(seen) > MEMO_WORDS and len(self.keys):
            self._reset()
        at = np.searchsorted(self.keys, seen)
        new = np.ones(len(seen), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != seen[inside]
        fresh = np.flatnonzero(new)
        if len(fresh):
            first = np.empty(len(seen), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            order, sizes, ids = self._encode(b, u, first[fresh])
            fresh = fresh[order]
            base = len(self.start) - 1
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
            order = np.argsort(seen[fresh])
            place = at[fresh][order]
            self.keys = np.insert(self.keys, place, seen[fresh][order])
            self.rows = np.insert(self.rows, place, base + order)
            at = np.searchsorted(self.keys, seen)
        return self.rows[at][codes], u.doc

    def counts(self, b: Block) -> np.ndarray:
        """Tokens of each row of the block."""
        r, doc = self.rows_of(b)
        return np.bincount(doc, weights=(self.start[r + 1] - self.start[r]), minlength=b.rows).astype(np.int64)

    def encode(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block in order, and the row offsets into them."""
        r, doc = self.rows_of(b)
        lo, size = self.start[r], self.start[r + 1] - self.start[r]
        total = int(size.sum())
        begin = np.cumsum(size) - size
        flat = np.arange(total) + np.repeat(lo - begin, size)
        off = np.zeros(b.rows + 1, np.int64)
        np.cumsum(np.bincount(doc, weights=size, minlength=b.rows).astype(np.int64), out=off[1:])
        return self.ids[flat], off


_CODERS: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """The process's coder for the file (a memo across tasks; results never depend on it)."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]
