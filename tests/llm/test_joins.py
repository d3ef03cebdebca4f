"""Operators 1 and 5 against brute force."""

import random

import numpy as np
import pytest

from retainly.llm import jaccard_join as J
from retainly.llm import substring_dedup as S

from . import brute, odd


def heavy_rows(seed):
    """Near copies of a few bases over a small vocabulary, so frequent shingles fill the prefixes."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocab) for _ in range(n)] for n in (3, 5, 9, 20, 60, 130, 400)]
    out = []
    for i in range(350):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, len(w) // 30, len(w) // 20])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w += [rng.choice(vocab) for _ in range(rng.randrange(0, max(1, len(w) // 3)))]
        out.append((i, " ".join(w)))
    return out


def test_components_of_odd_rows(spark):
    data = [r for r in odd.rows() if r[0] is not None]
    got = J.jaccard_components(odd.frame(spark, data)).collect()
    assert odd.ordered(got) == odd.ordered(brute.jaccard_components([r[:2] for r in data]))


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    data = [(1, a, None, None), (5, a + " x", None, None), (5, b + " y", None, None), (9, b, None, None), (9, b, None, None)]
    got = {(r.doc_id, r.component_id) for r in J.jaccard_components(odd.frame(spark, data)).collect()}
    assert got == {(1, 1), (5, 1), (9, 1)}


def test_rows_without_an_id_are_returned(spark):
    got = J.jaccard_components(odd.frame(spark, [(None, "a b", "en", "s"), (1, "a b", "en", "s")])).collect()
    assert odd.ordered(got) == odd.ordered([(None, 1, None), (1, 1, 1)])


@pytest.mark.parametrize("buckets", [64, J.BUCKETS])
def test_frequent_classes_and_salts(spark, monkeypatch, buckets):
    data = heavy_rows(buckets)
    real = J.Order.__init__

    def low(self, seen, percent):  # everything beyond 3 documents counts as frequent, beyond 40 as very frequent
        real(self, seen, percent)
        self.level, self.seen = (seen > 3).astype(np.int8) + (seen > 40), seen

    monkeypatch.setattr(J.Order, "__init__", low)
    monkeypatch.setattr(J, "SALT_ROWS", 50)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert odd.ordered(J.jaccard_components(df, n_buckets=buckets).collect()) == odd.ordered(brute.jaccard_components(data))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    order = J.Order(np.r_[np.zeros(500, int), np.full(12, 5000), np.full(2, 10**7)], 75)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = rng.choice(2**40, n, replace=False).astype(np.uint64) * np.uint64(514) + rng.choice([0, 501, 505, 512, 513], n).astype(np.uint64)
        a = np.unique(a)
        drop = int(rng.integers(0, len(a) // 4 + 1))
        b = rng.permutation(a)[drop:]
        add = max(0, int(len(b) / 0.75 - len(a))) if rng.random() < 0.5 else 0
        b = np.unique(np.r_[b, rng.choice(2**40, add).astype(np.uint64) * np.uint64(514) + np.uint64(505)])
        common = len(np.intersect1d(a, b))
        if 100 * common < 75 * (len(a) + len(b) - common):
            continue
        sigs = []
        for s in (a, b):
            bucket = J.bucket_of(s, 514)
            rows, h = J.distinct_sets(np.zeros(len(s), int), s, np.where(order.level[bucket] > 0, order.seen[bucket], 0))
            sigs.append(set(J.signatures(rows, h, 1, order)[1].tolist()))
        assert sigs[0] & sigs[1]


def test_one_per_group(spark):
    data = odd.rows()
    df = odd.frame(spark, data)
    got = J.one_per_group(df)
    assert got.columns == df.columns
    want = {d for d, _, c in brute.jaccard_components([r[:2] for r in data if r[0] is not None]) if d == c}
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_substring_dedup_of_odd_rows(spark):
    data = [r for r in odd.rows(2) if r[0] is not None]
    got = S.dedup_digests(odd.frame(spark, data)).collect()
    assert odd.ordered(got) == odd.ordered(brute.substring_dedup([r[:2] for r in data]))


@pytest.mark.parametrize("n_cells", [64, 4096])
def test_substring_dedup_with_common_cells(spark, n_cells):
    rng = random.Random(n_cells)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([12, 13, 14, 20, 60]))] for _ in range(12)]
    data = []
    for _ in range(200):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [rng.choice(vocab) for _ in range(rng.randrange(0, 25))] + (rng.choice(passages) if rng.random() < 0.6 else [])
        data.append((rng.randrange(0, 10**6), " \n".join(["x"] * rng.randrange(1, 60) if rng.random() < 0.1 else w)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert odd.ordered(S.dedup_digests(df, n_cells=n_cells).collect()) == odd.ordered(brute.substring_dedup(data))


def test_cover_aligns_every_pair():
    for i in range(S.PERIOD):
        for j in range(S.PERIOD):
            assert any((i + d) % S.PERIOD in S.COVER and (j + d) % S.PERIOD in S.COVER for d in range(S.PERIOD))


def test_empty_tables(spark):
    assert J.jaccard_components(odd.empty(spark)).count() == 0
    assert J.one_per_group(odd.empty(spark)).count() == 0
    assert S.dedup_digests(odd.empty(spark)).count() == 0
