"""Near duplicates of embeddings by randomised-rotation binary codes with stored correction factors.

Two vectors link when their cosine is at least ``cosine``. Vectors are compared as unit
vectors of double precision.

1. Rows of equal vectors are one class (a partially aggregated shuffle); every class has a
   number, its weight and its smallest id. Classes are written.
2. Centres are fitted on a bounded sample of classes (``SAMPLE``): leaders that are apart from
   one another, at most about the square root of the number of classes and ``CENTRES``; a
   leader with near copies moves to their mean. Every class is indexed: its home is its
   nearest centre, and it asks the ``PROBES`` nearest ones.
3. A home entry stores the code of its residual o - c: one bit per dimension of the randomly
   rotated residual, and the correction factors: the residual's length r and the product a of
   the unit residual with its code. For a question q with unit residual y, s = <y, code>:
   s / a estimates the inner product without bias, with the confidence bound
   ``SIGMAS`` * sqrt((1 - a^2) / (a^2 (d - 1))); the certain bounds are
   a s +- sqrt((1 - a^2)(1 - s^2)). Pairs whose upper bound misses the threshold are dropped,
   pairs whose certain lower bound reaches it link, all others are recomputed in double
   precision from the vectors themselves.
4. Members of a home whose stored lengths say that any two of them link (2 r below the
   distance of the threshold) are its ball: they are counted together and never compared. So a
   group of near copies costs its number of rows, not its square. The others of a home are
   its shell. A question goes to the ball or shell only where the triangle inequality leaves a
   link possible.
5. Large homes are dealt into blocks of bounded size against blocks of questions; a task holds
   one pair of blocks. It returns a count for each node and a spanning forest of the links it
   found, never the pairs. A pair counts for both sides if either asked the other's home: each
   side counts what it asked for, and the answering side counts where it did not ask itself.
6. Links become components over balls and remaining nodes.

Bounds (nothing is dropped beyond them): ``SAMPLE`` only places centres; the index holds every
class. A link is missed where neither side asks the other's home; tests measure recall
against brute force (1.0 on the shared tables, above 0.97 at the threshold itself on random
directions). A home of many vectors that are near the threshold but not near copies is
compared in blocks, in proportion to its square.

Defined results: a vector that is null, zero or holds null or non-finite entries links with
nothing; shorter vectors count as ending in zeros; repeated rows link with one another and are
each returned; a row without an id can link, never gives its name to a component, and is kept
if no id is reachable; an empty table gives no rows; other columns do not pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components, unite
from ._store import ship, stored
from ._text import columns
from ._vectors import dense, dimension, narrow, packed, unpacked

COSINE = 0.9
SAMPLE = 16_384
CENTRES = 4096
PROBES = 8
SIGMAS = 5.0
APART = 0.75  # centres have a smaller cosine
HOME_BLOCK, ASK_BLOCK = 2048, 4096
SEED = 42
MARGIN = 1e-5  # float32 products

_ROW = pa.schema([("vec_id", pa.int64()), ("vec", pa.binary())])
_PLACED = pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("vec", pa.binary()), ("home", pa.int32()), ("r", pa.float64()),
                     ("ball", pa.bool_()), ("code", pa.binary()), ("a", pa.float64()), ("asked", pa.list_(pa.int32())),
                     ("distance", pa.list_(pa.float64()))])
_PLACED_DDL = ("node bigint, weight bigint, vec binary, home int, r double, ball boolean, code binary, a double, "
               "asked array<int>, distance array<double>")
_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_FOUND_DDL = "node bigint, links bigint, a bigint, b bigint"


@dataclass
class Index:
    centres: np.ndarray  # float64, unit
    rotation: np.ndarray  # orthogonal
    cosine: float
    sigmas: float = SIGMAS
    probes: int = PROBES

    @property
    def dim(self) -> int:
        return self.rotation.shape[0]

    @property
    def reach(self) -> float:
        """The distance of unit vectors at the threshold."""
        return float(np.sqrt(max(0.0, 2 - 2 * self.cosine)))

    def nearest(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the nearest centres, nearest first, and their distances."""
        p = min(self.probes, len(self.centres))
        dots = u @ self.centres.T
        some = np.argpartition(-dots, p - 1, axis=1)[:, :p]
        at = np.take_along_axis(dots, some, 1)
        order = np.lexsort((some, -at), axis=1)
        near = np.take_along_axis(some, order, 1)
        return near, np.linalg.norm(u[:, None, :] - self.centres[near], axis=2)

    def residuals(self, u: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated unit residuals and their lengths; a residual of no length is zero."""
        y = (u - centre) @ self.rotation
        r = np.linalg.norm(y, axis=1)
        return y / np.where(r > 0, r, 1)[:, None], r

    def encode(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign bits of rotated unit residuals, and the product of each with its code."""
        return np.packbits(y >= 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])

    def signs(self, bits: np.ndarray) -> np.ndarray:
        on = np.unpackbits(bits, axis=1, count=self.dim)
        return (on.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.dim))


def units(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest entry first so that no square leaves the range of doubles."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt(np.square(m).sum(axis=1))[:, None]


def fit_index(u: np.ndarray, size: int, cosine: float = COSINE, probes: int = PROBES, seed: int = SEED) -> Index:
    """Centres from sampled unit vectors: leaders in the given order that are apart, moved to the mean of their near copies."""
    taken = np.zeros((0, u.shape[1]))
    for i in range(0, len(u), 256):
        part = u[i:i + 256]
        free = (part @ taken.T).max(axis=1, initial=-1) < APART
        part = part[free]
        close = part @ part.T >= APART
        keep = np.zeros(len(part), bool)
        for j in range(len(part)):
            keep[j] = not (close[j] & keep).any()
        taken = np.concatenate([taken, part[keep]])[:size]
        if len(taken) == size:
            break
    best, at = np.full(len(u), -2.0), np.zeros(len(u), np.int64)
    for i in range(0, len(u), 1024):
        dots = u[i:i + 1024] @ taken.T
        at[i:i + 1024], best[i:i + 1024] = dots.argmax(axis=1), dots.max(axis=1)
    near = best >= cosine
    sums = np.zeros_like(taken)
    np.add.at(sums, at[near], u[near])
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((u.shape[1], u.shape[1])))[0]
    return Index(units(np.where((sums != 0).any(axis=1, keepdims=True), sums, taken)), rotation, cosine, probes=probes)


def decide(index: Index, q: np.ndarray, o: np.ndarray, centre: np.ndarray, bits: np.ndarray, r: np.ndarray, a: np.ndarray):
    """Which of the pairs (question, home entry) link: matrix of bool, and how many pairs were recomputed."""
    y, rq = index.residuals(q, centre)
    s = np.clip(y.astype(np.float32) @ index.signs(bits).T, -1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = (np.square(rq)[:, None] + np.square(r)[None, :] - index.reach**2) / (2 * rq[:, None] * r[None, :])
        wide = np.sqrt(1 - np.minimum(a, 1) ** 2)
        slack = wide[None, :] * np.sqrt(1 - np.square(s))
        sure = a[None, :] * s - slack >= need + MARGIN
        estimate = s / a + index.sigmas * wide / (a * np.sqrt(max(1, index.dim - 1)))
        possible = np.minimum(a[None, :] * s + slack, estimate) >= need - MARGIN
    # residuals of almost no length have no direction to go by
    blind = (rq < 1e-4)[:, None] | (r < 1e-4)[None, :]
    linked = sure & ~blind
    i, j = np.nonzero((possible | blind) & ~linked)
    for k in range(0, len(i), 16_384):
        ii, jj = i[k:k + 16_384], j[k:k + 16_384]
        linked[ii, jj] = np.square(q[ii] - o[jj]).sum(axis=1) <= index.reach**2 + 1e-9
        at = np.flatnonzero(linked[ii, jj])
        linked[ii[at], jj[at]] = (q[ii[at]] * o[jj[at]]).sum(axis=1) >= index.cosine
    return linked, len(i)


def _rows(rows: DataFrame, dim: int) -> DataFrame:
    """(vec_id, vec): packed vectors, null where a vector links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, m = dense(b.column(1), dim)
            some = (m != 0).any(axis=1)
            vec = np.full(len(ok), None, object)
            at = np.flatnonzero(ok)[some]
            for i, raw in zip(at.tolist(), packed(m[some], np.float32, np.float64)):
                vec[i] = raw
            yield columns(_ROW, vec_id=b.column(0), vec=pa.array(vec.tolist(), pa.binary()))

    return rows.mapInArrow(run, "vec_id bigint, vec binary")


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return units(unpacked(col, dim, np.float32, np.float64, np.float64))


def _placed(classes: DataFrame, shared) -> DataFrame:
    """Every class with its home, code, correction factors and the centres it asks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                u = _matrix(b.column("vec"), index.dim)
                asked, distance = index.nearest(u)
                y, r = index.residuals(u, index.centres[asked[:, 0]])
                bits, a = index.encode(y)
                yield columns(_PLACED, node=b.column("node"), weight=b.column("weight"), vec=b.column("vec"), home=asked[:, 0].astype(np.int32),
                              r=r, ball=2 * r <= index.reach - MARGIN, code=[x.tobytes() for x in bits], a=a,
                              asked=asked.astype(np.int32).tolist(), distance=distance.tolist())

    return classes.select("node", "weight", "vec").mapInArrow(run, _PLACED_DDL)


def _compare(table: pa.Table, shared) -> Iterator[pa.RecordBatch]:
    """Counts and a spanning forest of the links between the home entries and the questions of one pair of blocks."""
    index: Index = shared.value
    is_home = table.column("is_home").to_numpy()
    h, q = table.filter(pa.array(is_home)), table.filter(pa.array(~is_home))
    if not h.num_rows or not q.num_rows:
        return
    o, u = (_matrix(t.column("vec").combine_chunks(), index.dim) for t in (h, q))
    bits = np.frombuffer(b"".join(h.column("code").to_pylist()), np.uint8).reshape(h.num_rows, -1)
    r, a, node, rep, weight = (h.column(c).to_numpy() for c in ("r", "a", "node", "rep", "weight"))
    q_node, q_rep, q_weight, q_sub = (q.column(c).to_numpy() for c in ("node", "rep", "weight", "own"))
    asks = np.full((h.num_rows, 2 * index.probes), -1)
    for i, x in enumerate(h.column("subs").to_pylist()):
        asks[i, :len(x)] = x
    centre = index.centres[int(table.column("sub")[0].as_py()) // 2]
    counts, q_counts = np.zeros(h.num_rows, np.int64), np.zeros(q.num_rows, np.int64)
    names, at = np.unique(np.concatenate([rep, q_rep]), return_inverse=True)
    mine, theirs, parent = at[:h.num_rows], at[h.num_rows:], np.arange(len(names))
    for i in range(0, q.num_rows, 256):
        part = slice(i, i + 256)
        linked, _ = decide(index, u[part], o, centre, bits, r, a)
        linked &= q_node[part][:, None] != node[None, :]
        k, j = np.nonzero(linked)
        k += i
        if not len(k):
            continue
        np.add.at(q_counts, k, weight[j])
        unasked = ~(asks[j] == q_sub[k][:, None]).any(axis=1)
        np.add.at(counts, j[unasked], q_weight[k[unasked]])
        parent = unite(parent, theirs[k], mine[j])
    for ids, c in ((node, counts), (q_node, q_counts)):
        some = c > 0
        none = pa.nulls(int(some.sum()))
        yield columns(_FOUND, node=ids[some], links=c[some], a=none, b=none)
    up = np.flatnonzero(parent != np.arange(len(parent)))
    none = pa.nulls(len(up))
    yield columns(_FOUND, node=none, links=none, a=names[up], b=names[parent[up]])


def _sample(spark: SparkSession, classes: DataFrame, n: int, dim: int) -> np.ndarray:
    """At most 2 * ``SAMPLE`` classes picked by a hash of their number, in the hash's order."""
    every = -(-n // SAMPLE)
    got = (classes.select(F.xxhash64("node").alias("h"), "vec").filter(F.pmod("h", F.lit(every)) == 0)
           .limit(2 * SAMPLE).toArrow().sort_by("h"))
    return _matrix(got.column("vec").combine_chunks(), dim)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES, centres: int = CENTRES,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    source = narrow(vectors, id_col, vector_col)
    dim = dimension(source)
    digest = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(SEED), "vec").alias("h2")]
    rows = _rows(source, dim)
    classes = stored(rows.filter("vec IS NOT NULL").groupBy("vec").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"))
                     .withColumn("node", F.monotonically_increasing_id()).select("node", "weight", "low", "vec", *digest), "classes")
    n = classes.count()
    if n == 0:
        ids = source.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        return ids.withColumn("kept", F.lit(True))
    size = 1 << max(0, int(np.ceil(np.log2(np.sqrt(n)))))
    index = fit_index(_sample(spark, classes, n, dim), min(centres, size), cosine, probes)
    shared = spark.sparkContext.broadcast(index)  # at most ``centres`` x dim doubles
    placed = stored(_placed(classes, shared), "placed")

    # by home and ball or shell: at most 2 * ``centres`` rows
    own = (F.col("home") * 2 + F.when(F.col("ball"), 0).otherwise(1))
    got = (placed.groupBy(own.alias("sub")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.min("node").alias("rep"),
                                                F.min("r").alias("near"), F.max("r").alias("far")).collect())
    subs = 2 * len(index.centres)
    count, weight, rep = np.zeros(subs, np.int64), np.zeros(subs, np.int64), np.zeros(subs, np.int64)
    near, far = np.full(subs, np.inf), np.full(subs, -np.inf)
    for g in got:
        count[g["sub"]], weight[g["sub"]], rep[g["sub"]], near[g["sub"]], far[g["sub"]] = g["n"], g["weight"], g["rep"], g["near"], g["far"]
    table = spark.sparkContext.broadcast((count, weight, rep, near, far))
    reach = index.reach + MARGIN

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the sublist a class belongs to, the node that stands for it, what its ball gives it, and the sublists it asks."""
        count, weight, rep, near, far = table.value
        for b in batches:
            home, ball, node, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("home", "ball", "node", "weight"))
            asked = b.column("asked").values.to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1), int)
            d = b.column("distance").values.to_numpy().reshape(asked.shape)
            mine = home * 2 + ~ball
            lists = np.stack([asked * 2, asked * 2 + 1], axis=2).reshape(b.num_rows, -1)
            d = np.repeat(d, 2, axis=1)
            go = (count[lists] > 0) & (d <= far[lists] + reach) & (d >= near[lists] - reach)
            go &= ~(ball[:, None] & (lists == mine[:, None]))  # a ball's pairs are known
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("weight"), pa.array(mine, pa.int32()), pa.array(np.where(ball, rep[mine], node), pa.int64()),
                 pa.array(np.where(ball, weight[mine] - w, 0), pa.int64()), pa.array([x[g].tolist() for x, g in zip(lists, go)], pa.list_(pa.int32())),
                 b.column("vec"), b.column("r"), b.column("code"), b.column("a")],
                names=["node", "weight", "own", "rep", "sure", "subs", "vec", "r", "code", "a"])

    known = stored(placed.mapInArrow(described, "node bigint, weight bigint, own int, rep bigint, sure bigint, subs array<int>, vec binary, "
                                                "r double, code binary, a double"), "known")
    asking = known.withColumn("sub", F.explode("subs"))
    asks = np.zeros(subs, np.int64)
    for g in asking.groupBy("sub").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2 * ``centres`` rows
        asks[g["sub"]] = g["n"]
    home_blocks, ask_blocks = np.maximum(1, -(-count // HOME_BLOCK)), np.maximum(1, -(-asks // ASK_BLOCK))
    blocks = spark.createDataFrame([(int(s), int(home_blocks[s]), int(ask_blocks[s])) for s in np.flatnonzero((count > 0) & (asks > 0))],
                                   "sub int, hb int, qb int")
    draw = F.xxhash64("node")
    entries = (known.withColumn("sub", F.col("own")).join(F.broadcast(blocks), "sub")  # ``blocks``: at most 2 * ``centres`` rows
               .withColumn("i", F.pmod(draw, F.col("hb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))))
    questions = (asking.join(F.broadcast(blocks), "sub").withColumn("j", F.pmod(draw, F.col("qb")).cast("int"))
                 .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("hb") - 1))))
    none = F.lit(None)
    cells = entries.select("sub", "i", "j", F.lit(True).alias("is_home"), "node", "rep", "weight", "own", "subs", "vec", "r", "code", "a").unionByName(
        questions.select("sub", "i", "j", F.lit(False).alias("is_home"), "node", "rep", "weight", "own", none.cast("array<int>").alias("subs"),
                         "vec", none.cast("double").alias("r"), none.cast("binary").alias("code"), none.cast("double").alias("a")))
    found = stored(cells.groupBy("sub", "i", "j").applyInArrow(_per_group(shared), _FOUND_DDL), "found")

    joined = components(found.filter("a IS NOT NULL").select("a", "b"))
    counts = found.filter("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    comp = stored(joined.select(F.col("node").alias("rep"), "component"), "components")
    counts = stored(counts, "counts")
    whole = (known.select("node", "weight", "rep", "sure").join(comp, "rep", "left").join(counts, "node", "left")
             .select("node", F.coalesce("component", "rep").alias("component"),
                     (F.col("weight") - 1 + F.col("sure") + F.coalesce("links", F.lit(0))).alias("n_links")))
    whole = stored(whole.join(classes.select("node", "low", "h1", "h2"), "node"), "linked")
    lows = stored(whole.groupBy("component").agg(F.min("low").alias("component_id")), "lows")
    result = stored(whole.join(lows, "component").select("h1", "h2", "n_links", "component_id"), "result")
    keyed = rows.select("vec_id", *(F.when(F.col("vec").isNotNull(), d).alias(k) for d, k in zip(digest, ("h1", "h2"))))
    out = keyed.join(result, ["h1", "h2"], "left")
    lone = F.col("n_links").isNull()
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.when(lone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _per_group(shared):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_compare(table, shared)), schema=_FOUND)
    return run
