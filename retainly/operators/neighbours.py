"""k nearest neighbours by cells: an exact self-join in several dimensions without emitting all pairs.

1. Equal (vector, label) rows become one row with a multiplicity, numbered in (vector, label) order; from
   here on rows meet by that number, never by the vector.
2. A median-split tree over a bounded sample (``SAMPLE`` vectors, at most ``MAX_CELLS`` leaves) deals all
   vectors to cells; each cell keeps the true minimum and maximum of every dimension. The sample decides
   how well cells prune, never what is found.
3. A query meets its own cell: the distance of its k-th neighbour there bounds the true one.
4. It then goes to every cell whose box is no farther than that bound, found down the tree of boxes; each returns
   at most k candidates and the nearest k of all are kept.

A cell's queries are dealt in blocks of ``BLOCK`` rows, so a task holds one cell's distinct vectors and one block.
Distances are sums of squares in column order; ties go by (vector, label). Rows with a null or NaN feature
neither ask nor answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..session import reliable_checkpoint

SAMPLE = 1 << 18
MAX_CELLS = 1 << 14
CELL_ROWS = 2000
BLOCK = 20_000
PAIRS = 1 << 21  # distances held at once in a task


class Cells:
    """Median-split tree over sampled vectors: ``dim`` and ``cut`` of inner nodes, heap numbered; a leaf is a cell."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros(max(1, (1 << depth) - 1), np.int32)
        self.cut = np.full(len(self.dim), np.inf)  # an unsplit node sends all to its left child
        members = {0: np.arange(len(sample))}
        for node in range((1 << depth) - 1):
            at = members.pop(node, np.empty(0, int))
            left = right = at
            if len(at) > 1:
                x = sample[at]
                j = int(np.argmax(np.quantile(x, 0.9, axis=0) - np.quantile(x, 0.1, axis=0) + 1e-9 * np.ptp(x, axis=0)))
                values = np.unique(x[:, j])
                if len(values) > 1:
                    cut = np.median(x[:, j])
                    self.dim[node], self.cut[node] = j, cut if cut > values[0] else values[1]
            goes = sample[at, self.dim[node]] < self.cut[node] if len(at) else np.empty(0, bool)
            left, right = at[goes], at[~goes]
            members[2 * node + 1], members[2 * node + 2] = left, right

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        row = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 2 - (x[row, self.dim[node]] < self.cut[node])
        return node - ((1 << self.depth) - 1)


class Boxes:
    """The bounds of cells and of all nodes above them, heap numbered: what is too far from a node is too far from its cells."""

    def __init__(self, number: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int):
        self.first = (1 << depth) - 1  # the node of cell 0
        self.low = np.full((2 * self.first + 1, low.shape[1]), np.inf)
        self.high = -self.low
        self.low[self.first + number], self.high[self.first + number] = low, high
        for node in range(self.first - 1, -1, -1):
            self.low[node] = np.minimum(self.low[2 * node + 1], self.low[2 * node + 2])
            self.high[node] = np.maximum(self.high[2 * node + 1], self.high[2 * node + 2])
        self.full = (self.low <= self.high).all(axis=1)

    def within(self, v: np.ndarray, r: np.ndarray):
        """(row, cell) of each cell with rows whose box is no farther than the row's ``r``, in order of rows, and the boxes compared."""
        row, node, compared = np.arange(len(v)), np.zeros(len(v), np.int64), 0
        while True:
            keep = self.full[node]
            row, node = row[keep], node[keep]
            gap = np.zeros(len(row))
            for j in range(v.shape[1]):  # squares in column order as in distances, so rounding never loses a cell
                p = v[row, j]
                gap += np.maximum(np.maximum(self.low[node, j] - p, p - self.high[node, j]), 0.0) ** 2
            compared += len(row)
            keep = np.sqrt(gap) <= r[row]
            row, node = row[keep], node[keep]
            if not len(node) or node[0] >= self.first:
                return row, node - self.first, compared
            row, node = np.repeat(row, 2), (2 * node[:, None] + [1, 2]).ravel()


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=float).reshape(-1, dims)


def _nearest(q: np.ndarray, qid: np.ndarray, refs: np.ndarray, vid: np.ndarray, mult: np.ndarray, k: int):
    """(query row, reference row, distance, copies) of every query's k nearest references, copies counted; ``vid`` ascends."""
    step = max(1, PAIRS // max(1, len(refs)))
    last = min(k + 1, len(refs)) - 1  # its own row may come before k others
    for i in range(0, len(q) if len(refs) else 0, step):
        part = q[i:i + step]
        d = np.zeros((len(part), len(refs)))
        for j in range(q.shape[1]):
            d += (part[:, j, None] - refs[None, :, j]) ** 2
        d = np.sqrt(d)
        row, ref = np.nonzero(d <= np.partition(d, last, axis=1)[:, last, None])
        dist = d[row, ref]
        order = np.lexsort((ref, dist, row))
        row, ref, dist = row[order], ref[order], dist[order]
        copies = mult[ref] - (vid[ref] == qid[i + row])
        keep = copies > 0
        row, ref, dist, copies = row[keep], ref[keep], dist[keep], copies[keep]
        total = np.cumsum(copies) - copies
        first = np.searchsorted(row, row)  # where the query's rows begin
        keep = total - total[first] < k
        yield i + row[keep], ref[keep], dist[keep], copies[keep]


def _spread(df: DataFrame, blocks: dict[int, int], every: bool) -> DataFrame:
    """Deals rows to the blocks of their cell: to all (references), or to one by ``vid`` (queries). At most ``MAX_CELLS`` entries."""
    many = {c: b for c, b in blocks.items() if b > 1}
    if not many:
        return df.withColumn("block", F.lit(0))
    table = df.sparkSession.createDataFrame(list(many.items()), "cell int, blocks int")
    df = df.join(F.broadcast(table), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = (F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if every
             else F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    return df.withColumn("block", block).drop("blocks")


def _blocks(counts: DataFrame) -> dict[int, int]:
    return {r["cell"]: -(-r["count"] // BLOCK) for r in counts.groupBy("cell").count().collect()}


def exact_knn(refs: DataFrame, queries: DataFrame, features: list[str], k: int, label: str | None = None,
              cell_rows: int = CELL_ROWS, seed: int = 42) -> DataFrame:
    """k nearest reference vectors of every distinct query (vector, label); its own row does not count as a neighbour.

    ``queries`` must be a subset of ``refs``. Returns (qv, qy, nv, ny, dist, before, take): ``take`` copies of
    ``nv`` are neighbours number before + 1 and on. A query with fewer than k other references has no rows.
    """
    dims = len(features)
    lab = F.col(label) if label else F.lit(0)
    present = " AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(CAST(`{c}` AS DOUBLE))" for c in features)
    vec = F.array(*[F.col(c).cast("double") for c in features])
    d = (refs.filter(present).groupBy(vec.alias("v"), lab.alias("y")).agg(F.count(F.lit(1)).alias("m")))
    d = reliable_checkpoint(global_row_number(d, ["v", "y"], out="vid"))
    n = d.count()
    depth = max(0, int(np.ceil(np.log2(max(1, min(MAX_CELLS, n / cell_rows))))))
    sample = d.select("v") if n <= SAMPLE else d.sample(0.9 * SAMPLE / n, seed).select("v")
    cells = Cells(_matrix(sample.toArrow()["v"], dims) if depth else np.empty((0, dims)), depth)

    def dealt(batches):
        for x in batches:
            yield x.append_column("cell", pa.array(cells.of(_matrix(x.column("v"), dims)).astype(np.int32)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields)
    d = reliable_checkpoint(d.mapInArrow(dealt, f"{fields}, cell int"))
    edge = d.groupBy("cell").agg(*[f(F.col("v")[j]).alias(f"{s}{j}") for j in range(dims) for s, f in (("lo", F.min), ("hi", F.max))])
    edge = edge.toArrow()  # at most MAX_CELLS rows
    number = edge["cell"].to_numpy()
    low, high = (np.stack([edge[f"{s}{j}"].to_numpy() for j in range(dims)], 1) for s in ("lo", "hi"))
    boxes = Boxes(number, low, high, depth)

    asked = queries.filter(present).select(vec.alias("v"), lab.alias("y")).distinct()
    y_type = d.schema["y"].dataType.simpleString()
    q = d.join(asked, (d["v"] == asked["v"]) & d["y"].eqNullSafe(asked["y"]), "left_semi").select("vid", "v", "y", "cell")
    q = reliable_checkpoint(q)

    def bound(_, ask: pa.Table, ref: pa.Table) -> pa.Table:
        r = np.full(len(ask), np.inf)
        ref = ref.sort_by("vid")
        copies_of = ref["m"].to_numpy()
        for row, _, dist, copies in _nearest(_matrix(ask["v"], dims), ask["vid"].to_numpy(), _matrix(ref["v"], dims),
                                             ref["vid"].to_numpy(), copies_of, k):
            got = np.bincount(row, weights=copies, minlength=len(ask)) >= k
            far = np.zeros(len(ask))
            np.maximum.at(far, row, dist)
            r[got] = far[got]
        return pa.table({"vid": ask["vid"], "v": ask["v"], "y": ask["y"], "cell": ask["cell"], "r": pa.array(r)})

    own = _blocks(q)
    q_schema = f"vid bigint, v array<double>, y {y_type}, cell int"
    bounded = (_spread(q, own, False).groupBy("cell", "block")
               .cogroup(_spread(d, own, True).groupBy("cell", "block")).applyInArrow(bound, f"{q_schema}, r double"))

    def routed(batches):
        for x in batches:
            v, r = _matrix(x.column("v"), dims), x.column("r").to_numpy()
            step = max(1, PAIRS >> depth)  # pairs held at once, should a row go to every cell
            for i in range(0, len(v), step):
                row, cell, _ = boxes.within(v[i:i + step], r[i:i + step])
                for a in range(0, len(row), 50_000):
                    at = pa.array(i + row[a:a + 50_000])
                    yield pa.RecordBatch.from_arrays([*(x.column(c).take(at) for c in ("vid", "v", "y")),
                                                      pa.array(cell[a:a + 50_000].astype(np.int32))], ["vid", "v", "y", "cell"])

    goes = reliable_checkpoint(bounded.mapInArrow(routed, q_schema))

    def candidates(_, ask: pa.Table, ref: pa.Table) -> pa.Table:
        ref = ref.sort_by("vid")
        copies_of = ref["m"].to_numpy()
        parts = list(_nearest(_matrix(ask["v"], dims), ask["vid"].to_numpy(), _matrix(ref["v"], dims), ref["vid"].to_numpy(), copies_of, k))
        row, at, dist, copies = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t)
                                 for i, t in enumerate((int, int, float, int)))
        return pa.table({"qid": ask["vid"].take(pa.array(row)), "qv": ask["v"].take(pa.array(row)), "qy": ask["y"].take(pa.array(row)),
                         "nid": ref["vid"].take(pa.array(at)), "nv": ref["v"].take(pa.array(at)), "ny": ref["y"].take(pa.array(at)),
                         "dist": pa.array(dist), "em": pa.array(copies.astype(np.int64))})

    visits = _blocks(goes)
    found = (_spread(goes, visits, False).groupBy("cell", "block").cogroup(_spread(d, visits, True).groupBy("cell", "block"))
             .applyInArrow(candidates, f"qid bigint, qv array<double>, qy {y_type}, nid bigint, nv array<double>, ny {y_type}, dist double, em bigint"))
    w = Window.partitionBy("qid").orderBy("dist", "nid")  # at most k rows of each cell the query went to
    before = F.coalesce(F.sum("em").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("em").over(Window.partitionBy("qid"))
    return (found.withColumns({"before": before, "_all": total}).filter((F.col("before") < k) & (F.col("_all") >= k))
            .select("qv", "qy", "nv", "ny", "dist", "before", F.least(F.col("em"), F.lit(k) - F.col("before")).alias("take")))
