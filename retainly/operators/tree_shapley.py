"""Exact path-dependent Shapley values of saved tree ensembles.

The value of a coalition S is the tree's expectation when splits on features of S follow the row
and all other splits send it both ways, in proportion to the training rows behind each child.

A leaf with value v and d different features on its path adds to that value the product over
those features of one_i (the row takes all of the path's splits on i) for i in S, and zero_i (the
share of training rows that do) for the others, times v. Its Shapley values therefore depend on
the row only through the d bits one_i, and the sums over coalitions are polynomials in the coalition's
size. Leaves on the same features are summed before any row is read: one table holds their values
for every cell of the grid of their cuts (at most ``GRID`` cells), and a row gathers from its cell. For
leaves on more features, or on categories, a block of rows is reduced to the bit patterns that occur.
No permutations, no coalitions are enumerated. The tables are broadcast (bounded by the ensemble, not
by the rows); rows are dealt evenly to a task per ``ROWS_PER_TASK``.

Boosted trees are explained on the margin (the probability is 1 / (1 + exp(-2 margin))), forests
on the probability of class 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
GRID = 1 << 16
ROWS_PER_TASK = 1 << 17


@dataclass
class Leaf:
    """A path of an ensemble: its value and, for each different feature on it, the share of rows and the interval or categories."""

    value: float
    features: np.ndarray
    zero: np.ndarray
    low: np.ndarray  # a row takes the path where low < x <= high
    high: np.ndarray
    among: list  # for a categorical feature the categories that take the path, else None


def saved_ensemble(spark: SparkSession, path: str) -> list[Leaf]:
    """Leaves of the tree ensemble that pyspark.ml saved under ``path`` (a GBT or forest, classification or regression)."""
    trees: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # the model's nodes
        trees.setdefault(r.treeID, {})[r.id] = r
    meta = spark.read.parquet(f"{path}/treesMetadata").collect()  # one row a tree
    weights = {r[0]: r[2] for r in meta}
    forest = all("DecisionTreeClassificationModel" in r[1] for r in meta)
    share = {t: (1 / len(weights) if forest else w) for t, w in weights.items()}
    return [leaf for t, nodes in sorted(trees.items()) for leaf in _leaves(nodes, share[t], forest)]


def _leaves(nodes: dict, weight: float, forest: bool) -> Iterator[Leaf]:
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        node = nodes[at]
        if node.leftChild < 0:
            value = node.impurityStats[1] / sum(node.impurityStats) if forest else node.prediction
            items = sorted(path.items())
            yield Leaf(weight * value, np.array([f for f, _ in items], np.int64), np.array([s[0] for _, s in items]),
                       np.array([s[1] for _, s in items]), np.array([s[2] for _, s in items]), [s[3] for _, s in items])
            continue
        f, given, n_categories = node.split.featureIndex, node.split.leftCategoriesOrThreshold, node.split.numCategories
        for child, left in ((node.leftChild, True), (node.rightChild, False)):
            zero, low, high, among = path.get(f, (1.0, -np.inf, np.inf, None))
            zero *= nodes[child].rawCount / node.rawCount
            if n_categories < 0:
                low, high = (low, min(high, given[0])) if left else (max(low, given[0]), high)
            else:
                takes = set(given) if left else set(map(float, range(n_categories))) - set(given)
                among = takes if among is None else among & takes
            todo.append((child, {**path, f: (zero, low, high, among)}))


def leaf_values(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Shapley value of each feature (columns) of one leaf of value 1, for each pattern of bits (rows)."""
    d = len(zero)
    weight = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
    out = np.empty(one.shape)
    for j in range(d):
        poly = np.zeros((len(one), d))  # coefficients by coalition size, of the product over the others
        poly[:, 0] = 1
        for i in range(d):
            if i != j:
                up = poly * one[:, i:i + 1]
                poly *= zero[i]
                poly[:, 1:] += up[:, :-1]
        out[:, j] = (one[:, j] - zero[j]) * (poly @ weight)
    return out


def shapley_matrix(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Shapley values of rows (features as columns); an entry that is not a number takes right branches, as in the model."""
    phi = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        v = x[:, leaf.features]
        takes = ~(v <= leaf.low) & ((v <= leaf.high) | np.isposinf(leaf.high))
        for i, among in enumerate(leaf.among):
            if among is not None:
                takes[:, i] = np.isin(v[:, i], list(among))
        pattern = takes @ (1 << np.arange(d)) if d < 62 else np.unique(takes, axis=0, return_inverse=True)[1].ravel()
        _, first, of = np.unique(pattern, return_index=True, return_inverse=True)
        phi[:, leaf.features] += leaf.value * leaf_values(takes[first].astype(float), leaf.zero)[of]
    return phi


@dataclass
class Table:
    """Summed values of leaves on the same features: a column of ``values`` a feature, a row a cell of the grid of ``cuts``."""

    features: tuple[int, ...]
    cuts: list  # a feature's cuts, ascending; an entry's place is the number of cuts below it (NaN: all)
    values: np.ndarray


def _table(features: tuple[int, ...], leaves: list[Leaf], cuts: list) -> Table:
    d = len(features)
    patterns = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
    places = [np.arange(len(c) + 1) for c in cuts]
    values = np.zeros((d, np.prod([len(p) for p in places])))
    for leaf in leaves:
        pattern = np.zeros(1, np.int64)
        for i, (c, at) in enumerate(zip(cuts, places)):
            takes = (at > (np.searchsorted(c, leaf.low[i]) if leaf.low[i] > -np.inf else -1)) & (at <= np.searchsorted(c, leaf.high[i]))
            pattern = np.add.outer(pattern, takes.astype(np.int64) << i).ravel()
        values += (leaf.value * leaf_values(patterns, leaf.zero)).T[:, pattern]
    return Table(features, cuts, values)


def tabled(leaves: list[Leaf], grid: int | None = None) -> tuple[list[Table], list[Leaf]]:
    """Tables of the leaves whose grid has at most ``grid`` cells, and the leaves left over."""
    groups: dict[tuple, list[Leaf]] = {}
    plain = [x for x in leaves if len(x.features) and any(a is not None for a in x.among)]
    for leaf in leaves:
        if len(leaf.features) and all(a is None for a in leaf.among):
            groups.setdefault(tuple(leaf.features.tolist()), []).append(leaf)
    tables = []
    for features, group in sorted(groups.items()):
        edges = [np.unique([e for x in group for e in (x.low[i], x.high[i])]) for i in range(len(features))]
        cuts = [e[np.isfinite(e)] for e in edges]
        if np.prod([len(c) + 1.0 for c in cuts]) <= (GRID if grid is None else grid):
            tables.append(_table(features, group, cuts))
        else:
            plain += group
    return tables, plain


def tabled_matrix(x: np.ndarray, tables: list[Table], plain: list[Leaf]) -> np.ndarray:
    """``shapley_matrix`` of the leaves behind ``tables`` and ``plain``."""
    phi = np.ascontiguousarray(shapley_matrix(x, plain).T)
    used = sorted({f for t in tables for f in t.features})
    cuts = {f: np.unique(np.concatenate([c for t in tables for g, c in zip(t.features, t.cuts) if g == f])) for f in used}
    place = {f: np.searchsorted(cuts[f], x[:, f]) for f in used}  # numbers of cuts below; NaN sorts last
    for t in tables:
        cell = np.zeros(len(x), np.int64)
        for f, c in zip(t.features, t.cuts):
            own = np.concatenate([[0], np.searchsorted(c, cuts[f], side="right")])  # the place among the table's cuts
            cell = cell * (len(c) + 1) + own[place[f]]
        for f, v in zip(t.features, t.values):
            phi[f] += v[cell]
    return phi.T


def base_value(leaves: list[Leaf]) -> float:
    """The ensemble's expectation over its training rows: the value of the empty coalition."""
    return float(sum(leaf.value * leaf.zero.prod() for leaf in leaves))


def tree_shapley(df: DataFrame, key: str, features: list[str], leaves: list[Leaf]) -> DataFrame:
    """(key, feature, phi, base_value): one row per row and feature. Sums over a row's phi and base_value give the model's output.

    ``features`` in the order of the model's vector. A null feature counts as not a number.
    """
    shared = df.sparkSession.sparkContext.broadcast(tabled(leaves))
    base = base_value(leaves)
    narrow = df.select(key, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    narrow = narrow.repartition(max(1, -(-df.count() // ROWS_PER_TASK)))  # rows fill few tasks by their size, the output is wide
    kind = dict(narrow.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(i, BLOCK_ROWS)
                x = np.column_stack([b.column(k).fill_null(np.nan).to_numpy(zero_copy_only=False) for k in range(1, b.num_columns)])
                phi = tabled_matrix(x, *shared.value)
                ends = pa.array(np.arange(0, phi.size + 1, phi.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(phi.ravel()))], names=[key, "phi"])

    arrays = narrow.mapInArrow(run, f"`{key}` {kind}, phi array<double>")
    named = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("phi").alias("phi"))
    return arrays.select(key, F.inline(named)).withColumn("base_value", F.lit(base))
