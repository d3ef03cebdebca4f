"""Operators 2, 3 and 7: exact round trips with the tokenizer library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from retainly.llm import _tok, packing, token_counts, token_shards
from retainly.llm._text import blocks

from . import odd

STRANGE = ["don't a's 'tis 've it’s x—y ça!— é. ..é a b <|endoftext|> A<|endoftext|>b <|ENDOFTEXT|> éa. 5a5 $5.00a's'd",
           "İΣας ǅ ½ x étre", "a'S O'Reilly's 'Re 'll", "日本語 テスト one,two", "naïve café’s", "", None]


def check_packing(rows, texts, capacity, name="word_bpe_49k.json"):
    ids = {}
    for d, t in texts:
        ids.setdefault(d, []).append(_tok.encode_texts(odd.path(name), [t or ""])[0] + [0])
    want = Counter((d, k // capacity, k, len(v[k:k + capacity]), zlib.crc32(np.array(v[k:k + capacity], "<u4").tobytes()))
                   for d, all_ in ids.items() for v in all_ for k in range(0, len(v), capacity))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for v in used.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used), -(-sum(k[3] * c for k, c in want.items()) // capacity)


def test_packing_of_odd_rows(spark):
    data = odd.rows() + [(2000 + i, t, None, None) for i, t in enumerate(STRANGE)]
    rows = packing.pack(odd.frame(spark, data), odd.path()).collect()
    used, bound = check_packing(rows, [r[:2] for r in data], 2048)
    assert used <= bound + 1


@pytest.mark.parametrize("capacity", [7, 64])
def test_packing_small_sequences(spark, capacity):
    data = [r for r in odd.rows(5, 40) if r[1] is not odd.LONG and r[1] is not odd.ONE_WORD]
    rows = packing.pack(odd.frame(spark, data), odd.path(), capacity).collect()
    used, bound = check_packing(rows, [r[:2] for r in data], capacity)
    assert used <= 1.1 * bound + 1


def test_plan_keeps_every_item_and_is_near_optimal():
    rng = random.Random(4)
    for _ in range(200):
        cap = rng.choice([10, 20, 100])
        histogram = dict(Counter(rng.randrange(1, cap + 1) for _ in range(rng.randrange(0, 40))))
        plan = packing.Plan(histogram, cap)
        got, bins = Counter(), defaultdict(list)
        for w, rank, count, sequence, offset in plan.rows:
            got[w] += count
            for i in range(count):
                bins[sequence + i].append((offset, w))
        assert dict(got) == histogram and len(bins) == plan.sequences
        for v in bins.values():
            at = 0
            for offset, w in sorted(v):
                assert offset == at
                at += w
            assert at <= cap


def fewest(items, cap):
    """Exact number of bins by search, for small instances."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for k, b in enumerate(bins):
            if b + items[i] <= cap and b not in seen:
                seen.add(b)
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, bins + [items[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = random.Random(9)
    for _ in range(250):
        cap = rng.choice([10, 15, 30])
        items = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 11))]

        class Only(packing.Plan):
            def _best_fit(self):
                pass

        plan = Only(dict(Counter(items)), cap)
        rest = [w for w, c in plan.left.items() for _ in range(c)]
        assert plan.sequences + (fewest(rest, cap) if rest else 0) == fewest(items, cap), (items, cap)


def test_word_coder_equals_the_library():
    import pyarrow as pa
    texts = [t or "" for t in STRANGE] + [r[1] or "" for r in odd.rows(7)]
    coder = _tok.coder(odd.path())
    got = []
    for b in blocks(pa.array(texts, pa.string()), max_bytes=500):
        ids, off = coder.encode(b)
        got += [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:])]
    assert got == _tok.encode_texts(odd.path(), texts)


def test_word_coder_takes_marks_and_case_off_words():
    import pyarrow as pa
    rng = random.Random(5)
    marks = ["", "", "(", "$5", "--", "'", "|", "<|", "é", "\x7f", "\x00", "1a"]
    texts = ["".join(rng.choice([rng.choice(marks) + rng.choice(["the", "Thinreent", "ABLE", "x", ""]) + rng.choice(marks), " ", "\n"])
                     for _ in range(rng.randrange(6))) for _ in range(3000)]
    coder = _tok.WordCoder(odd.path())
    got = []
    for b in blocks(pa.array(texts, pa.string()), max_bytes=2000):
        ids, off = coder.encode(b)
        got += [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:])]
    assert got == _tok.encode_texts(odd.path(), texts)
    coder = _tok.WordCoder(odd.path())
    plain = [f"{a}{w}{z}" for w in ("thinreent", "Thinreent", "THINREENT") for a in ("", "(", "--") for z in ("", ".", "),")]
    for b in blocks(pa.array(plain, pa.string())):  # adjacent rows without white space between them
        coder.encode(b)
    assert len(coder.keys) == 5  # the letters, and each run of marks


def test_word_coder_memo_may_start_anew(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(_tok, "MEMO_WORDS", 50)
    monkeypatch.setattr(_tok, "MEMO_PARTS", 20)
    texts = [r[1] or "" for r in odd.rows(8, 30)]
    coder = _tok.WordCoder(odd.path())
    got = [int(n) for b in blocks(pa.array(texts, pa.string()), max_bytes=300) for n in coder.counts(b)]
    assert got == [len(v) for v in _tok.encode_texts(odd.path(), texts)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_chunked_texts(spark, name):
    rng = random.Random(3)
    vocab = ["Über", "naïve,", "the", "don't", "(x)", "42", "é", "日本", "$$$", "thinreent"]
    texts = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (5, 300, 900)]
    texts += ["z" * 2500 + " end of it " + "y" * 1200, "a  b\n\n c\t" * 200, texts[1], None, ""]
    data = [(i, t, None, None) for i, t in enumerate(texts)] + [(1, texts[1], None, None)]
    got = token_counts.token_counts(odd.frame(spark, data), odd.path(name), huge_bytes=400, chunk_chars=300, overlap=60).collect()
    want = [(d, len((t or "").encode()), n := len(_tok.encode_texts(odd.path(name), [t or ""])[0]), n > 2048) for d, t, _, _ in data]
    assert odd.ordered(got) == odd.ordered(want)


def test_counts_of_odd_rows(spark):
    data = odd.rows()
    got = token_counts.token_counts(odd.frame(spark, data), odd.path()).collect()
    n = [len(v) for v in _tok.encode_texts(odd.path(), [r[1] or "" for r in data])]
    assert odd.ordered(got) == odd.ordered((r[0], len((r[1] or "").encode()), k, k > 2048) for r, k in zip(data, n))


def test_counts_of_long_texts_without_an_id(spark):
    long = " ".join(f"word{i * 7919 % 1000}" for i in range(12_000))
    data = [(None, long, "en", "src0"), (1, long, "en", "src0"), (None, odd.LONG, "en", None), (None, odd.ONE_WORD * 2, None, None),
            (None, long, "en", "src1"), (2, odd.LONG, "en", None), (3, odd.ONE_WORD * 2, "en", None)]
    got = token_counts.token_counts(odd.frame(spark, data), odd.path())
    rows = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got.collect())
    of = {n_bytes: n for d, n_bytes, n in rows if d}
    whole = token_counts.token_counts(odd.frame(spark, data), odd.path(), huge_bytes=1 << 30)
    assert rows == sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in whole.collect())
    assert len(rows) == len(data) and all(n == of[n_bytes] for _, n_bytes, n in rows)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 4096, 5000):
        f = token_shards.Feistel(n, key=n)
        slots = f.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (f.sequence(slots) == np.arange(n)).all()
    assert (token_shards.Feistel(1000, 1).slot(np.arange(1000)) != token_shards.Feistel(1000, 2).slot(np.arange(1000))).any()


def test_shards_round_trip_and_resume(spark, tmp_path):
    data = [r for r in odd.rows() if r[1] is not odd.LONG]
    length, records = 16, 5
    out = str(tmp_path / "shards")
    n_seq = token_shards.write_shards(odd.frame(spark, data), odd.path(), out, length, records)
    rows = token_shards.read_records(spark, out, length=length).collect()
    assert sorted(r.slot for r in rows) == list(range(n_seq))
    assert all(r.shard == r.slot // records and r.record == r.slot % records and len(r.ids) == 2 * length for r in rows)
    f = token_shards.Feistel(n_seq)
    stream = b"".join(r.ids for r in sorted(rows, key=lambda r: int(f.sequence([r.slot])[0])))
    ids = np.frombuffer(stream, "<u2").tolist()
    docs, one = [], []
    for i in ids:
        one.append(i)
        if i == 0:
            docs.append(tuple(one))
            one = []
    want = Counter(tuple(v + [0]) for v in _tok.encode_texts(odd.path(), [r[1] or "" for r in data]))
    filled = n_seq * length - sum(len(k) * c for k, c in want.items())
    want[(0,)] += filled
    assert Counter(docs) == want and not one and 0 <= filled < length
    later = token_shards.read_records(spark, out, start=7, stop=23, length=length).collect()
    assert {(r.slot, bytes(r.ids)) for r in later} == {(r.slot, bytes(r.ids)) for r in rows if 7 <= r.slot < 23}


def test_ids_that_do_not_fit_raise(spark, tmp_path):
    with pytest.raises(Exception, match="does not fit"):
        token_shards.write_shards(odd.frame(spark, [(1, "a", None, None)]), odd.path(), str(tmp_path / "x"), end_id=70_000)


def test_empty_tables(spark):
    e = odd.empty(spark)
    assert packing.pack(e, odd.path()).count() == 0
    assert token_counts.token_counts(e, odd.path()).count() == 0
    assert token_shards.shard_digests(e, odd.path()).count() == 0
