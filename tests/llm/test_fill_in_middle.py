"""Operator 12 against slices of Python strings."""

import hashlib

import numpy as np
import pytest

from retainly.llm import fill_in_middle as F

from . import odd

TEXTS = ["", "a", "é", "💡", "plain ascii text", "naïve café — 東京 💡\n" * 7, "x" * 70_000, "é" * 40_000, "ab" * 30_000 + "東京" * 30_000,
         "has <P> inside", "ends with <S>", "<M>", "< P > <p>", "a\x00b", ("a" * 9 + "é") * 20_000, "💡" * 20_000]


def brute(doc_id, text):
    t = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(t), "spm", lo, hi - lo, f"<S>{t[hi:]}<P>{t[:lo]}<M>{t[lo:hi]}"
    return len(t), "psm", lo, hi - lo, f"<P>{t[:lo]}<S>{t[hi:]}<M>{t[lo:hi]}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("text", TEXTS)
def test_select_finds_every_boundary(text):
    raw = text.encode()
    at = F.BoundarySet(np.frombuffer(raw, np.uint8))
    assert len(at) == len(text)
    ends = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
    for k in sorted({0, len(text), *np.random.default_rng(0).integers(0, len(text) + 1, 200).tolist()}):
        assert at.select(k) == ends[k]
    for k in (-1, len(text) + 1):
        with pytest.raises(IndexError):
            at.select(k)


def test_all_container_forms():
    flags = {F.RunContainer: np.ones(F.CHUNK, bool), F.ArrayContainer: np.zeros(F.CHUNK, bool),
             F.BitmapContainer: np.random.default_rng(0).random(F.CHUNK) < 0.5}
    flags[F.ArrayContainer][np.random.default_rng(1).integers(0, F.CHUNK, 500)] = True
    for form, inside in flags.items():
        c = F.container(inside)
        assert type(c) is form and len(c) == inside.sum()
        assert [c.select(k) for k in range(0, len(c), 97)] == np.flatnonzero(inside)[::97].tolist()
    assert len(F.container(np.zeros(5, bool))) == 0


def test_rows_and_digests(spark):
    data = [*odd.rows(), *((2000 + 37 * k + i, t, "en", None) for k in range(6) for i, t in enumerate(TEXTS))]
    want = [(d, *brute(d, t)) for d, t, *_ in data]
    df = odd.frame(spark, data)
    got = F.fill_in_middle(df)
    assert odd.ordered(got.collect()) == odd.ordered(want)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    digests = F.fim_digests(df).collect()
    restored = {(d, sha(t or "")) for d, t, *_ in data}
    assert odd.ordered(r[:6] for r in digests) == odd.ordered((*r[:5], sha(r[5])) for r in want)
    assert {(r.doc_id, r.restored_sha256) for r in digests} == restored


def test_empty_table(spark):
    assert F.fill_in_middle(odd.empty(spark)).count() == 0 and F.fim_digests(odd.empty(spark)).count() == 0


def test_restoring_needs_the_form():
    with pytest.raises(ValueError):
        F.restore(b"<S>x<P>y<M>z", "psm")
