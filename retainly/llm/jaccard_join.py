"""N-gram Jaccard self-join by token-combination prefixes, down to components.

A document is its set of distinct 5-word shingles (lower-cased A-Z). Two documents link
when 100 * |intersection| >= ``percent`` * |union|.

1. One pass gives every set's size and 128-bit digest, and a table of ``BUCKETS``
   document-frequency counters over hashed shingles (a fixed size, summed on Spark).
   Documents with equal digests are one node.
2. Shingles in buckets well above the median are frequent (level 1) or very frequent
   (level 2). The global order is rare first, then by counter, then by hash. With t
   tokens of a set allowed to miss, its prefix is extended until any t deletions leave
   a whole combination: rare tokens are classes of one (indexed alone); frequent tokens
   fall into small classes in which combinations of 2 (level 2: of 3) are indexed, and a
   token guards only after its class holds k-1 others. Two linked sets share a signature.
   The classes depend on the size band, so a set is indexed for its own band and the next.
3. Rows of a signature are sorted by document in one shuffle and streamed: the first one
   leads and is paired with the others (a star, not all pairs). Signatures of buckets that
   hold many rows are salted and the salts' leaders are led once more.
   Rows carry the token's place in the order: a pair is only made where the place leaves
   enough tokens behind it in both sets, as it does at the first token two linked sets share.
4. These pairs first meet with their rare prefixes (4 bytes a token): what these share and
   what they leave unseen bounds the intersection from above. Pairs that the bound leaves are
   verified on whole texts, and linked nodes become components.
5. Signatures whose members are still in different components are compared inside tasks, in
   cells of bounded size: first by size and place, which leaves few rows and many equal groups of
   them, then the distinct groups by bitmaps of the whole sets: every bit that one set has and the
   other lacks is a token they do not share. A task returns a spanning forest of the pairs that
   this bound leaves, never the pairs. The forests' components are clusters: all pairs still to
   be decided lie inside one.
6. Every cluster is compared exactly, in cells of bounded text where members of one component
   stay together and are not compared with one another. Tasks return spanning forests of links.

Sketch counters only choose the order; every link found by comparing all pairs is found.

Defined results: null or word-less text has n_shingles 0 and is its own component; with
fewer words than a shingle the whole sequence is one; repeated rows are returned as often
as they occur, and rows that share a doc_id are one node; an empty table gives no rows;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components, unite
from ._store import discard, id_filter, may_hold, ship, stored, thinned
from ._text import _C, _K, Block, blocks, columns, give_back, mix, string_parts, window_hashes, windows, word_hashes

WORDS = 5
PERCENT = 75
BUCKETS = 1 << 18
SALT_ROWS = 200_000
PER_CLASS = 3
PAIR_BYTES = 2 << 20
MAP_WORDS = 1024  # of 64 bits, in a bitmap of a set
MAP_PAIRS = 1 << 18  # words of bitmaps that are compared at a time
CHUNK_PAIRS = 1 << 18
CELL_ROWS = 2048  # of one signature in a block
CLUSTER_ROWS, CLUSTER_BYTES = 512, 4 << 20  # of one cluster in a block
MIN_BAND = 32  # smaller sets index frequent tokens alone

_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_DOUBT = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("component", pa.int64())])
_PASS_ONE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                       ("bucket", pa.int32()), ("seen", pa.int64())])
_SIG = pa.schema([("sig", pa.int64()), ("salt", pa.int32()), ("doc", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])
_SIG_DDL = "sig bigint, salt int, doc bigint, n int, place int"
_MEMBER = pa.schema([("sig", pa.int64()), ("lead", pa.int64()), ("lead_n", pa.int32()), ("lead_place", pa.int32()),
                     ("doc", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("salted", pa.bool_())])
_MEMBER_DDL = "sig bigint, lead bigint, lead_n int, lead_place int, doc bigint, n int, place int, salted boolean"


def shingles(b: Block, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles, repeats included."""
    h = word_hashes(b)
    at, s = windows(h, b.doc, k)
    rows, counts = b.doc[at], b.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(b.doc, short)
        own = np.empty(len(short), np.uint64)
        for m in range(1, k):
            of = counts[short] == m
            own[of] = mix(window_hashes(h, first[of], m) + np.uint64(m * int(_K) % 2**64))
        rows, s = np.concatenate([rows, short]), np.concatenate([s, own])
    return rows, s


def distinct_sets(rows: np.ndarray, h: np.ndarray, order_key: np.ndarray | None = None):
    """Rows and hashes sorted by (row, order key, hash) without repeats."""
    first = rows.astype(np.uint64) << np.uint64(40)
    if order_key is not None:
        first = first | np.minimum(order_key, (1 << 40) - 1).astype(np.uint64)
    order = np.lexsort((h, first))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], h[new]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return (h % np.uint64(n_buckets)).astype(np.int64)


def _digests(docs: DataFrame, n_buckets: int, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_buckets, np.int64)
        for x in batches:
            for b in blocks(x.column(1), lower=True):
                rows, h = distinct_sets(*shingles(b, words))
                seen += np.bincount(bucket_of(h, n_buckets), minlength=n_buckets)
                n = np.bincount(rows, minlength=b.rows)
                at = np.searchsorted(rows, np.arange(b.rows))
                d = [np.zeros(b.rows, np.uint64) for _ in range(2)]
                full = n > 0
                if full.any():
                    for s, v in zip(d, (mix(h + _K), mix(h ^ _C[7]))):
                        s[full] = np.add.reduceat(v, at[full])
                none = pa.nulls(b.rows)
                yield columns(_PASS_ONE, doc_id=x.column(0).slice(b.first, b.rows), n=n, h1=signed(d[0]), h2=signed(d[1]),
                              bucket=none, seen=none)
        used = np.flatnonzero(seen)
        none = pa.nulls(len(used))
        yield columns(_PASS_ONE, doc_id=none, n=none, h1=none, h2=none, bucket=used.astype(np.int32), seen=seen[used])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, bucket int, seen bigint")


class Order:
    """Levels and order of hashed tokens, from the frequency counters, and the size bands."""

    def __init__(self, seen: np.ndarray, percent: int):
        middle = float(np.median(seen))
        self.limit = middle + 6 * np.sqrt(middle) + 32
        self.seen = np.maximum(seen - int(middle), 0)
        self.level = (seen > self.limit).astype(np.int8) + (seen > middle + 64 * (self.limit - middle))
        self.percent = percent
        edges, e = [], Fraction(1)
        while e < 2**40:
            edges.append(-(-e.numerator // e.denominator))
            e = e * 100 / percent if percent < 100 else e * 2
        self.edges = np.array(edges, np.int64)

    def may_miss(self, n: np.ndarray) -> np.ndarray:
        """Tokens a set of n may have outside a set it links to: |intersection| >= percent% of n."""
        return n - -(-self.percent * n // 100)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1

    def classes(self, band: np.ndarray) -> np.ndarray:
        """Classes of frequent tokens in a band's structure; 0 where tokens are indexed alone."""
        e = self.edges[np.minimum(band, len(self.edges) - 1)]
        return np.where(e < MIN_BAND, 0, np.maximum(1, self.may_miss(e) // PER_CLASS))


def signatures(rows: np.ndarray, h: np.ndarray, n_rows: int, order: Order) -> tuple[np.ndarray, ...]:
    """(row, signature, counter of its rarest token, place) of every set; ``rows``, ``h`` as from ``distinct_sets`` in
    the order. The place of a combination is 0."""
    n = np.bincount(rows, minlength=n_rows)
    start = np.cumsum(n) - n
    bucket = bucket_of(h, len(order.seen))
    level = order.level[bucket]
    need = order.may_miss(n) + 1
    rank = np.arange(len(h)) - start[rows]
    rare = (level == 0) & (rank < need[rows])
    out = [(rows[rare], mix(h[rare] ^ _C[11]), np.zeros(int(rare.sum()), np.int64), rank[rare])]
    missing = need - np.bincount(rows[level == 0], minlength=n_rows)
    at = np.flatnonzero((level > 0) & (missing[rows] > 0))
    if len(at):
        r, hh, lv, count = rows[at], h[at], level[at], order.seen[bucket[at]]
        for step in (0, 1):
            band = order.band(np.maximum(n[r], 1)) + step
            out += [(*c, np.zeros(len(c[0]), np.int64)) for c in
                    _combinations(r, hh, lv, count, missing[r], band, order.classes(band))]
    return tuple(np.concatenate(v) for v in zip(*out))


def _combinations(r, h, level, count, missing, band, n_classes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Combinations of frequent tokens of the same class in the extended prefix of one band's structure."""
    alone = n_classes == 0
    k = np.where(alone, 1, level + 1)
    cls = np.where(alone, 0, (h >> np.uint64(20)) % np.maximum(n_classes, 1).astype(np.uint64)).astype(np.int64) * 4 + k
    by_class = np.lexsort((np.arange(len(r)), cls, r))  # keeps the global order inside a class
    rc, cc = r[by_class], cls[by_class]
    new = np.ones(len(rc), bool)
    new[1:] = (rc[1:] != rc[:-1]) | (cc[1:] != cc[:-1])
    idx = np.arange(len(rc))
    nth = np.empty(len(rc), np.int64)
    nth[by_class] = idx - np.maximum.accumulate(np.where(new, idx, 0))
    guards = (nth >= k - 1).astype(np.int64)
    total = np.cumsum(guards) - guards
    head = np.ones(len(r), bool)
    head[1:] = r[1:] != r[:-1]
    before = total - np.maximum.accumulate(np.where(head, total, 0))
    inside = by_class[(before < missing)[by_class]]
    r, h, k, cls, count = r[inside], h[inside], k[inside], cls[inside], count[inside]
    tag = mix((band[inside].astype(np.uint64) << np.uint64(2)) + k.astype(np.uint64) + _C[13])
    out = []
    one = k == 1
    if one.any():
        out.append((r[one], mix(h[one] ^ tag[one]), count[one]))

    def same(i, j):
        return (r[i] == r[j]) & (cls[i] == cls[j])

    d = 1
    while True:  # second token d places on
        i = np.arange(len(r) - d)
        i = i[same(i, i + d) & (k[i] >= 2)] if len(i) else i
        if not len(i):
            break
        two = i[k[i] == 2]
        out.append((r[two], mix(h[two] * _C[0] + h[two + d] * _C[1] + tag[two]), np.minimum(count[two], count[two + d])))
        three, e = i[k[i] == 3], d + 1
        while True:  # third token e places on
            t = three[three + e < len(r)]
            t = t[same(t, t + e)]
            if not len(t):
                break
            out.append((r[t], mix(h[t] * _C[0] + h[t + d] * _C[1] + h[t + e] * _C[2] + tag[t]),
                        np.minimum(np.minimum(count[t], count[t + d]), count[t + e])))
            e += 1
        d += 1
    return out


def _signature_rows(docs: DataFrame, shared, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: Order = shared.value
        for x in batches:
            for b in blocks(x.column(1), lower=True):
                rows, h = shingles(b, words)
                bucket = bucket_of(h, len(order.seen))
                rows, h = distinct_sets(rows, h, np.where(order.level[bucket] > 0, order.seen[bucket], 0))
                n = np.bincount(rows, minlength=b.rows)
                r, sig, count, at = signatures(rows, h, b.rows, order)
                ids = x.column(0).slice(b.first, b.rows).to_numpy(zero_copy_only=False)
                doc = ids[r]
                salts = 1 + count // SALT_ROWS
                salt = np.where(salts > 1, (mix(doc.astype(np.int64).view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64), -1)
                for i in range(0, len(r), 200_000):
                    j = slice(i, i + 200_000)
                    yield columns(_SIG, sig=signed(sig[j]), salt=salt[j].astype(np.int32), doc=doc[j], n=n[r[j]].astype(np.int32),
                                  place=at[j].astype(np.int32))

    return docs.mapInArrow(run, _SIG_DDL)


def stars(rows: DataFrame) -> DataFrame:
    """Every member of a signature beside the signature's first document; groups of one give nothing.

    Rows arrive sorted by (sig, salt, doc); the stream carries only the current leader.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for x in batches:
            if not x.num_rows:
                continue
            sig, salt, doc, n, place = (x.column(c).to_numpy() for c in ("sig", "salt", "doc", "n", "place"))
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
            new[0] = last is None or last[:2] != (sig[0], salt[0])
            at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            going_on = at < 0
            lead = [v[np.maximum(at, 0)] for v in (doc, n, place)]
            if going_on.any():
                for v, w in zip(lead, last[2:]):
                    v[going_on] = w
            # a salted leader is kept too, as its own member, to be led once more
            keep = (doc != lead[0]) | (new & (salt >= 0))
            yield columns(_MEMBER, sig=sig[keep], lead=lead[0][keep], lead_n=lead[1][keep], lead_place=lead[2][keep],
                          doc=doc[keep], n=n[keep], place=place[keep], salted=salt[keep] >= 0)
            last = (sig[-1], salt[-1], *(v[-1] for v in lead))

    dealt = rows.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "doc")
    return dealt.mapInArrow(run, _MEMBER_DDL)


def may_link(n, place, m, place_m, percent: int):
    """Whether sets of n and m tokens whose first common token has these places can link: the tokens from there on
    reach the intersection that ``percent`` of the union asks for, percent / (100 + percent) of n + m."""
    n, m = n.cast("bigint"), m.cast("bigint")
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & ((100 + percent) * F.least(n - place, m - place_m) >= percent * (n + m)))


def rare_prefixes(docs: DataFrame, shared, held, words: int) -> DataFrame:
    """Of the ids that the filter ``held`` may hold: (node, n, tops, all_rare, bits, bytes): the upper 4 bytes of the rare
    tokens of each prefix, in order, a bitmap of the whole set, and the text's size; one row per id and set."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("tops", pa.binary()), ("all_rare", pa.bool_()), ("bits", pa.binary()),
                        ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: Order = shared.value
        for x in batches:
            x = x.filter(pa.array(may_hold(x.column(0), held.value)))
            for b in blocks(x.column(1), lower=True):
                rows, h = distinct_sets(*shingles(b, words))
                n = np.bincount(rows, minlength=b.rows)
                rare = order.level[bucket_of(h, len(order.seen))] == 0
                r, hr = rows[rare], h[rare]
                n_rare = np.bincount(r, minlength=b.rows)
                need = order.may_miss(n) + 1
                first = np.arange(len(r)) - (np.cumsum(n_rare) - n_rare)[r] < need[r]
                r, tops = r[first], (hr[first] >> np.uint64(32)).astype("<u4")
                cut = np.searchsorted(r, np.arange(b.rows + 1))
                raw = tops.tobytes()
                yield columns(schema, node=x.column(0).slice(b.first, b.rows), n=n.astype(np.int32),
                              tops=[raw[4 * i:4 * j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())], all_rare=n_rare <= need,
                              bits=bitmaps(rows, h, n), bytes=np.diff(b.offsets))

    return docs.mapInArrow(run, "node bigint, n int, tops binary, all_rare boolean, bits binary, bytes bigint").dropDuplicates()


def bounded(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes leave a link possible."""
    def values(x: pa.RecordBatch, side: str):
        col = x.column(f"tops_{side}").cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], "<u4") if col.buffers()[2] is not None else np.zeros(0, "<u4")
        top = data[off[0] // 4:off[-1] // 4].astype(np.int64)
        size = np.diff(off) // 4
        row = np.repeat(np.arange(len(size)), size)
        limit = np.full(len(size), 1 << 32)
        open_ = ~x.column(f"all_{side}").to_numpy(zero_copy_only=False) & (size > 0)
        limit[open_] = top[(np.cumsum(size) - 1)[open_]]
        return row, top, limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            m = x.num_rows
            (ra, ta, la), (rb, tb, lb) = values(x, "a"), values(x, "b")
            limit = np.minimum(la, lb)  # below it, each prefix shows all rare tokens of its set
            ka, kb = ((r[t < limit[r]] << 32) | t[t < limit[r]] for r, t in ((ra, ta), (rb, tb)))
            shared = np.bincount(ka[np.isin(ka, kb)] >> 32, minlength=m)
            unseen = np.minimum(x.column("na").to_numpy() - np.bincount(ka >> 32, minlength=m),
                                x.column("nb").to_numpy() - np.bincount(kb >> 32, minlength=m))
            n = x.column("na").to_numpy().astype(np.int64) + x.column("nb").to_numpy()
            keep = (100 + percent) * (shared + unseen) >= percent * n
            yield x.select(["a", "b"]).filter(pa.array(keep))

    a, b = (prefixes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("tops").alias(f"tops_{k}"),
                            F.col("all_rare").alias(f"all_{k}")) for k in "ab")
    return pairs.join(b, "b").join(a, "a").mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) whose texts link. A task holds the sets of ``PAIR_BYTES`` of text at a time, or of one pair."""
    def linked(ta: pa.Array, tb: pa.Array) -> np.ndarray:
        m = len(ta)
        sets = [(*distinct_sets(*shingles(b, words)), b.first) for b in blocks(pa.concat_arrays([ta, tb]), lower=True)]
        rows = np.concatenate([r + f for r, _, f in sets])
        n = np.bincount(rows, minlength=2 * m)
        union = np.bincount(distinct_sets(rows % m, np.concatenate([v for _, v, _ in sets]))[0], minlength=m)
        return (union > 0) & (100 * (n[:m] + n[m:] - union) >= percent * union)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            size = np.cumsum(sum(np.diff(string_parts(x.column(c))[1]) for c in ("ta", "tb")))
            i = 0
            while i < x.num_rows:
                done = size[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(size, done + PAIR_BYTES, "right")))
                part = x.slice(i, j - i)
                yield part.select(["a", "b"]).filter(pa.array(linked(part.column("ta"), part.column("tb"))))
                i = j

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def bitmaps(rows: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A bitmap of each set's hashed tokens: 64 bits times a power of two, at least one a token up to ``MAP_WORDS`` words."""
    w = np.minimum(2 ** np.ceil(np.log2(np.maximum(1, n / 64))).astype(np.int64), MAP_WORDS)
    off = np.cumsum(w) - w
    flags = np.zeros(64 * int(w.sum()), bool)
    flags[64 * off[rows] + ((h >> np.uint64(13)) % (64 * w[rows]).astype(np.uint64)).astype(np.int64)] = True
    raw = np.packbits(flags, bitorder="little").tobytes()
    return [raw[8 * i:8 * (i + k)] for i, k in zip(off.tolist(), w.tolist())]


def folded(flat: np.ndarray, off: np.ndarray, words: np.ndarray, w: int) -> np.ndarray:
    """The bitmaps at ``off``, of ``words`` words, folded to ``w`` words each."""
    out = np.empty((len(off), w), np.uint64)
    for size in np.unique(words):
        at = words == size
        m = flat[off[at][:, None] + np.arange(size)]
        out[at] = np.bitwise_or.reduce(m.reshape(len(m), size // w, w), axis=1)
    return out


def may_share(flat, off, words, n, a, b, percent: int) -> np.ndarray:
    """Whether the bitmaps of the sets a and b leave a link possible."""
    keep = np.zeros(len(a), bool)
    least = np.minimum(words[a], words[b])
    for w in np.unique(least):
        at = np.flatnonzero(least == w)
        for i in range(0, len(at), max(1, MAP_PAIRS // int(w))):
            t = at[i:i + max(1, MAP_PAIRS // int(w))]
            x, y = (folded(flat, off[k[t]], words[k[t]], int(w)) for k in (a, b))
            shared = np.minimum(n[a[t]] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64),
                                n[b[t]] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            keep[t] = (100 + percent) * shared >= percent * (n[a[t]] + n[b[t]])
    return keep


def cells_of(cells: DataFrame, keys: list[str], forest, schema: str = "a bigint, b bigint") -> DataFrame:
    """``forest`` (record batch of whole cells, first rows of the cells -> record batches) over all cells of ``keys``.

    Cells have a bounded size, so a task holds one Arrow batch and one cell.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in batches:
            if not x.num_rows:
                continue
            x = x if held is None else pa.Table.from_batches([held, x]).combine_chunks().to_batches()[0]
            new = starts_of(x)
            held = x.slice(new[-1])
            if new[-1]:
                yield from forest(x.slice(0, new[-1]), new[:-1])
        if held is not None:
            yield from forest(held, starts_of(held))
        give_back()

    def starts_of(x: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(x.num_rows, bool)
        new[0] = True
        for k in keys:
            v = x.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def pairs_of(starts: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same cell, in chunks."""
    end = np.repeat(np.append(starts[1:], rows), np.diff(np.append(starts, rows)))
    count = end - np.arange(rows) - 1
    total = np.cumsum(count)
    i = 0
    while i < rows:
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + CHUNK_PAIRS, "right")))
        a = np.repeat(np.arange(i, j), count[i:j])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(total[i:j] - count[i:j] - done, count[i:j])
        i = j


def _forest(node: np.ndarray, parent: np.ndarray) -> pa.RecordBatch:
    up = np.flatnonzero(parent != np.arange(len(parent)))
    return columns(_LINK, a=node[up], b=node[parent[up]])


def in_doubt(each: DataFrame, percent: int) -> DataFrame:
    """(s1, s2, node, n, component): the rows that some row of another component in their signature may link to, by size
    and place, as sets of rows. Signatures with the same rows left, as those of one passage are, give one set.

    ``each``: (sig, m, node, n, place, component), m the signature's number of rows.
    """
    def sets(x: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, comp, place, blk, bi, bj = (x.column(c).to_numpy() for c in ("node", "component", "place", "blk", "bi", "bj"))
        n = x.column("n").to_numpy().astype(np.int64)
        left, cross = n - place, bi != bj
        keep = np.zeros(len(node), bool)
        for a, b in pairs_of(starts, len(node)):
            ok = (comp[a] != comp[b]) & ~(cross[a] & (blk[a] == blk[b]))
            a, b = a[ok], b[ok]
            ok = (100 + percent) * np.minimum(left[a], left[b]) >= percent * (n[a] + n[b])
            ok &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            keep[a[ok]] = True
            keep[b[ok]] = True
        cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
        at = np.flatnonzero(keep)
        h = mix(node[at].view(np.uint64) * _K + n[at].astype(np.uint64))
        names = []
        for v in (mix(h + _C[3]), mix(h ^ _C[5])):
            total = np.zeros(len(starts), np.uint64)
            np.add.at(total, cell[at], v)
            names.append(total[cell[at]].view(np.int64))
        yield columns(_DOUBT, s1=names[0], s2=names[1], node=node[at], n=n[at].astype(np.int32), component=comp[at])

    own = each.withColumn("nb", F.ceil(F.col("m") / CELL_ROWS).cast("int")).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    dealt = (own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("sig", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk", "node", "n", "place", "component"))
    return cells_of(dealt, ["sig", "bi", "bj"], sets, "s1 bigint, s2 bigint, node bigint, n int, component bigint").distinct()


def undecided(doubt: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Spanning forests (a, b) of the pairs across components of one set that the bitmaps leave possible.

    ``doubt``: as from ``in_doubt``; ``maps``: (node, n, bits), a row per set of tokens.
    """
    def forest(x: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, comp = (x.column(c).to_numpy() for c in ("node", "component"))
        n = x.column("n").to_numpy().astype(np.int64)
        bits = x.column("bits").cast(pa.large_binary())
        off = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset:bits.offset + len(bits) + 1]
        flat = np.frombuffer(bits.buffers()[2], "u1")[off[0]:off[-1]].view("<u8")
        words, off = np.diff(off) // 8, (off[:-1] - off[0]) // 8
        parent = np.arange(len(node))
        for a, b in pairs_of(starts, len(node)):
            ok = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
            ok &= parent[a] != parent[b]  # the forest needs no pair twice
            a, b = a[ok], b[ok]
            ok = may_share(flat, off, words, n, a, b, percent)
            parent = unite(parent, a[ok], b[ok])
        yield _forest(node, parent)

    return cells_of(doubt.join(maps, ["node", "n"]), ["s1", "s2"], forest)


def exact_links(clusters: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Spanning forests (a, b) of the links between different components of one cluster.

    ``clusters``: (node, cluster, component, bytes); ``texts``: (node, text). A component with many members or much
    text has cells of its own, and these do not meet one another; the others of a cluster are pooled.
    """
    def share(rows, size):
        return F.greatest(F.ceil(rows / CLUSTER_ROWS), F.ceil(size / CLUSTER_BYTES), F.lit(1)).cast("int")

    parts = clusters.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("size"))
    parts = stored(parts.withColumn("own", F.when((F.col("rows") * 2 >= CLUSTER_ROWS) | (F.col("size") * 2 >= CLUSTER_BYTES),
                                                  share(F.col("rows"), F.col("size")))), "parts")
    pools = stored(parts.filter("own IS NULL").groupBy("cluster").agg(share(F.sum("rows"), F.sum("size")).alias("pool")), "pools")
    none = F.lit(-1).cast("bigint")
    blocks_ = stored(pools.select("cluster", none.alias("of"), F.explode(F.sequence(F.lit(0), F.col("pool") - 1)).alias("k")).unionByName(
        parts.filter("own IS NOT NULL").select("cluster", F.col("component").alias("of"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("k"))),
        "blocks")
    x, y = (blocks_.select("cluster", F.col("of").alias(f"of_{s}"), F.col("k").alias(f"k_{s}")) for s in "xy")
    meets = stored(x.join(y, "cluster").filter((F.col("of_x") != F.col("of_y")) | (F.col("of_x") == -1)), "meets")  # blocks, not rows
    placed = (clusters.join(parts.select("cluster", "component", "own"), ["cluster", "component"]).join(pools, "cluster", "left")
              .select("node", "cluster", "component", F.when(F.col("own").isNull(), none).otherwise(F.col("component")).alias("of"),
                      F.when(F.col("own").isNull(), F.pmod(F.xxhash64("component"), F.col("pool")))
                      .otherwise(F.pmod(F.xxhash64("node"), F.col("own"))).cast("int").alias("k")))
    mine, other = F.struct("of_x", "k_x"), F.struct(F.col("of_y").alias("of_x"), F.col("k_y").alias("k_x"))
    low, high = F.least(mine, other), F.greatest(mine, other)
    dealt = (texts.join(stored(placed, "placed"), "node")
             .join(meets.withColumnsRenamed({"of_x": "of", "k_x": "k"}), ["cluster", "of", "k"])
             .withColumnsRenamed({"of": "of_x", "k": "k_x"})
             .select("cluster", low["of_x"].alias("c1"), low["k_x"].alias("k1"), high["of_x"].alias("c2"), high["k_x"].alias("k2"),
                     (mine == low).alias("first"), "node", "component", "text"))

    def forest(x: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, comp, first = (x.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "first"))
        same = (x.column("c1").to_numpy() == x.column("c2").to_numpy()) & (x.column("k1").to_numpy() == x.column("k2").to_numpy())
        ends = np.append(starts[1:], len(node))
        parent = np.arange(len(node))
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            sets = [(*distinct_sets(*shingles(b, words)), b.first) for b in blocks(x.column("text").slice(lo, hi - lo), lower=True)]
            rows = np.concatenate([r + f for r, _, f in sets])
            tokens = np.unique(np.concatenate([h for _, h, _ in sets]), return_inverse=True)[1]
            n = np.bincount(rows, minlength=hi - lo)
            at = np.append(0, np.cumsum(n))
            flag = np.zeros(len(tokens) + 1, np.int64)
            for i in range(hi - lo - 1):
                apart = comp[lo + i + 1:hi] != comp[lo + i]
                if not same[lo]:
                    apart &= first[lo + i + 1:hi] != first[lo + i]
                to = i + 1 + np.flatnonzero(apart & (100 * np.minimum(n[i], n[i + 1:]) >= percent * np.maximum(n[i], n[i + 1:])))
                if not len(to):
                    continue
                flag[tokens[at[i]:at[i + 1]]] = 1
                seen = np.append(0, np.cumsum(flag[tokens[at[i + 1]:]]))
                common = seen[at[to + 1] - at[i + 1]] - seen[at[to] - at[i + 1]]
                flag[tokens[at[i]:at[i + 1]]] = 0
                hit = lo + to[(100 + percent) * common >= percent * (n[i] + n[to])]
                parent = unite(parent, np.full(len(hit), lo + i), hit)
        yield _forest(node, parent)

    return cells_of(dealt, ["cluster", "c1", "k1", "c2", "k2"], forest)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id",
                       text_col: str = "text", n_buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = stored(_digests(narrow, n_buckets, words), "digests")
    seen = np.zeros(n_buckets, np.int64)
    for r in first.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("seen").alias("seen")).collect():  # <= n_buckets rows
        seen[r.bucket] = r.seen
    order = spark.sparkContext.broadcast(Order(seen, percent))

    sets = first.filter("bucket IS NULL").select("doc_id", "n", "h1", "h2")
    # written first: a join with a stored table can split the rows of a text with many copies
    classes = stored(sets.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = stored(sets.join(classes, ["n", "h1", "h2"], "left")
                   .select("doc_id", "n", F.coalesce("node", "doc_id").alias("node")), "nodes")
    discard(first, classes)
    copies = nodes.filter("node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()

    rows = _signature_rows(narrow.filter("doc_id IS NOT NULL"), order, words)
    members = stored(stars(rows), "members")
    again = members.filter("salted").select("sig", F.lit(-1).alias("salt"), F.col("lead").alias("doc"), F.col("lead_n").alias("n"),
                                            F.col("lead_place").alias("place")).distinct()
    groups = members.filter("lead <> doc").drop("salted").unionByName(stars(again).drop("salted"))
    node_of = nodes.select("doc_id", "node").distinct()

    # the first document of each group against the others, as nodes
    close = groups.filter(may_link(F.col("lead_n"), F.col("lead_place"), F.col("n"), F.col("place"), percent)).select("lead", "doc").distinct()
    close = (close.join(node_of.select(F.col("doc_id").alias("lead"), F.col("node").alias("x")), "lead")
             .join(node_of.select(F.col("doc_id").alias("doc"), F.col("node").alias("y")), "doc").filter("x <> y")
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    close = stored(close, "pairs")

    touched = stored(groups.select("lead").union(groups.select("doc")).distinct()
                     .join(node_of, F.col("lead") == F.col("doc_id")).select("node").distinct(), "touched")
    n_rows = nodes.count()
    prefixes = stored(rare_prefixes(narrow, order, id_filter(touched, n_rows), words), "prefixes")

    def linked(pairs: DataFrame) -> DataFrame:
        left = stored(bounded(pairs, prefixes, percent).distinct(), "bounded")
        ids = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        texts = thinned(narrow, "doc_id", id_filter(ids, n_rows))
        texts = (texts.join(ids, texts["doc_id"] == ids["node"], "left_semi").select(F.col("doc_id").alias("node"), "text")
                 .dropDuplicates())
        return stored(verify(left, texts, percent, words).distinct(), "links")

    links = linked(close)
    found = stored(components(links), "components")

    # members of one signature that are still in different components
    placed = stored(nodes.groupBy("doc_id").agg(F.min("node").alias("node"))
                    .join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component")), "placed")
    each = (groups.select("sig", F.col("doc").alias("doc_id"), "n", "place")
            .union(groups.select("sig", "lead", "lead_n", "lead_place")).distinct())
    each = stored(each.join(placed, "doc_id").select("sig", "node", "n", "place", "component").distinct(), "each")
    discard(members)
    mixed = stored(each.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"))
                   .filter("lo < hi").select("sig", "m"), "mixed")
    doubt = stored(in_doubt(each.join(mixed, "sig"), percent), "doubt")
    discard(each, mixed)
    forests = stored(undecided(doubt, prefixes.select("node", "n", "bits"), percent), "forests")
    clusters = stored(components(forests).select("node", F.col("component").alias("cluster")), "clusters")
    clusters = stored(clusters.join(placed.select("node", "component").distinct(), "node").join(prefixes.groupBy("node").agg(F.sum("bytes").alias("bytes")), "node"), "clusters")
    texts = thinned(narrow, "doc_id", id_filter(clusters.select("node"), n_rows))
    texts = texts.select(F.col("doc_id").alias("node"), "text").dropDuplicates()
    more = stored(exact_links(clusters, texts, percent, words), "links")
    final = stored(components(links.union(more).union(copies)), "components")
    return (nodes.join(final, nodes["doc_id"] == final["node"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def one_per_group(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component left, that of its smallest id; columns unchanged.

    Of rows that repeat an id the smallest (by all columns) stays; rows without an id stay.
    Only rows that a bitmap of the ids in question lets through are shuffled.
    """
    groups = stored(jaccard_components(docs, percent, words, id_col, text_col).filter("doc_id IS NOT NULL")
                    .groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "groups")
    concerned = groups.filter("n > 1 OR component_id <> doc_id")
    dropped = concerned.filter("component_id <> doc_id").select(F.col("doc_id").alias("dropped_id"))
    shared = id_filter(concerned.select("doc_id"), groups.count())
    sure = thinned(docs, id_col, shared, absent=True)
    maybe = thinned(docs, id_col, shared).filter(F.col(id_col).isNotNull())
    maybe = maybe.join(dropped, maybe[id_col].cast("bigint") == dropped["dropped_id"], "left_anti")
    kept = maybe.groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("_row"))
    return sure.unionByName(kept.select("_row.*"))
