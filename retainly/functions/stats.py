"""Per-column statistics in ONE aggregation, returned in long form.

``column_stats`` builds a single ``agg`` over all requested columns (one scan,
partial aggregation map-side) and unpivots it to (column, stat...) rows, so
the number of jobs does not grow with the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString().split("(")[0] in NUMERIC and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in exclude]


def column_stats(df: DataFrame, cols: list[str], stats: dict[str, Callable[[Column], Column]],
                 name_col: str = "column") -> DataFrame:
    """One row per column with one field per statistic.

    ``stats`` maps an output name to a function ``Column -> aggregate Column``.
    Implemented as a single wide ``agg`` followed by a ``stack``-style unpivot.
    """
    aggs = [fn(F.col(c)).alias(f"{i}__{s}") for i, c in enumerate(cols) for s, fn in stats.items()]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias(name_col), *[F.col(f"`{i}__{s}`").alias(s) for s in stats])
               for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*structs)))


def kolmogorov_pvalue(lam: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov survival function Q(lam) = 2 sum (-1)^(j-1) exp(-2 j^2 lam^2), clipped to [0,1]."""
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, j: acc + F.pow(F.lit(-1.0), j - 1) * F.exp(F.lit(-2.0) * j * j * lam * lam))
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


# ---- driver-side special functions for small results (p-values) ----

def _gammainc_lower_reg(a: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = 1.0 / a
        total = term
        n = 0
        while abs(term) > abs(total) * 1e-15 and n < 10000:
            n += 1
            term *= x / (a + n)
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    return 1.0 - _gammainc_upper_cf(a, x)


def _gammainc_upper_cf(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(stat: float, df: int) -> float:
    """Upper tail of the chi-square distribution."""
    if stat is None or df is None or df <= 0:
        return float("nan")
    return max(0.0, 1.0 - _gammainc_lower_reg(df / 2.0, stat / 2.0))


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1, a - 1
    c, d = 1.0, 1 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1 / d
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


def kolmogorov_sf(lam: float, terms: int = 100) -> float:
    if lam <= 0:
        return 1.0
    s = sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, terms + 1))
    return min(1.0, max(0.0, 2 * s))


def pearson(a, b):
    """Correlation over the rows where both are present; null where one of them does not vary (``corr`` raises under ANSI)."""
    x = F.when(b.isNotNull(), a).cast("double")
    y = F.when(a.isNotNull(), b).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


#: Rows of a rank's cell that are sorted by one task; larger cells are refined.
CELL_ROWS = 65_536
SKETCH_ACCURACY = 10_000  # ranks of a sketch are off by at most 1 / SKETCH_ACCURACY of the rows
MAX_ROUNDS = 12


def _around(probs: list[float]) -> list[float]:
    """Two sketch ranks around every position, each further off than the sketch errs; close positions share theirs."""
    off = 2.0 / SKETCH_ACCURACY
    out, last = set(), None
    for p in sorted(probs):
        if last is None or p - last > off / 2:
            out |= {max(0.0, p - off), min(1.0, p + off)}
            last = p
    return sorted(out)


@dataclass
class _Cell:
    """The values of a column strictly between two of its values (None: unbounded); ``ranks`` are wanted inside."""

    column: str
    low: float | None
    high: float | None
    below: int  # rows of the column before the cell
    n: int
    ranks: list[int]

    def value(self) -> Column:
        v = F.col(self.column).cast("double")
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (v > F.lit(self.low))
        if self.high is not None:
            inside = inside & (v < F.lit(self.high))
        return F.when(inside, v)

    def probs(self) -> list[float]:
        """Two sketch ranks around every wanted one, each further off than the sketch errs."""
        return _around([(k - self.below) / max(1, self.n - 1) for k in self.ranks])


def _in_cells(df: DataFrame, cells: list[_Cell], at: Callable[[int, Column], Column] | None = None) -> DataFrame:
    """(cell, value) of the rows inside each cell, or (cell, at) with a number of the value."""
    name, of = ("at", at) if at else ("value", lambda i, v: v)
    return (df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("cell"), F.when(c.value().isNotNull(), of(i, c.value())).alias(name)) for i, c in enumerate(cells)])))
            .filter(F.col(name).isNotNull()))


def _order(v: float):
    return (True, 0.0) if math.isnan(v) else (False, v)  # NaN is the largest, as in Spark


def _sketch(c: _Cell, probs: list[float]) -> Column:
    return F.percentile_approx(c.value(), probs, SKETCH_ACCURACY)


def _edges(sketched: list[float] | None) -> list[float]:
    """Sorted distinct values of a sketch (they are values of rows)."""
    by_order = {_order(v): v for v in sketched or []}
    return [by_order[k] for k in sorted(by_order)]


def _refine(df: DataFrame, cells: list[_Cell], edges: list[list[float]]) -> tuple[dict, list[_Cell]]:
    """({(column, rank): value} of ranks that fall on an edge, the smaller cells of the others)."""
    # the number of a value: odd for an edge itself, even for the values between two edges
    def number(v: Column, ee: list[float]) -> Column:
        out = F.lit(0)
        for e in ee:
            out = out + (v > F.lit(e)).cast("int") + (v >= F.lit(e)).cast("int")
        return out

    rows = _in_cells(df, cells, lambda i, v: number(v, edges[i]))
    counts: list[dict[int, int]] = [{} for _ in cells]
    for r in rows.groupBy("cell", "at").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["cell"]][r["at"]] = r["n"]  # at most 2 * edges + 1 rows a cell
    found, smaller = {}, []
    for c, ee, n in zip(cells, edges, counts):
        before = c.below
        for at in range(2 * len(ee) + 1):
            here = n.get(at, 0)
            ranks = [k for k in c.ranks if before <= k < before + here]
            if ranks and at % 2:
                found.update({(c.column, k): ee[at // 2] for k in ranks})
            elif ranks:
                low = ee[at // 2 - 1] if at else c.low
                high = ee[at // 2] if at // 2 < len(ee) else c.high
                smaller.append(_Cell(c.column, low, high, before, here, ranks))
            before += here
    return found, smaller


def _resolve(df: DataFrame, cells: list[_Cell]) -> dict:
    """{(column, rank): value}: the cells' distinct values with their counts, summed in order within each cell."""
    from .ranking import prefix_sum

    counts = _in_cells(df, cells).groupBy("cell", "value").agg(F.count(F.lit(1)).alias("n"))
    if max(c.n for c in cells) <= CELL_ROWS:
        w = Window.partitionBy("cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        pos = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    else:  # cells that no sketch divides go over range partitions
        pos = prefix_sum(counts, ["value"], "n", out="before", group_cols=["cell"])
    wanted = F.array(*[F.array(*[F.lit(k - c.below).cast("bigint") for k in c.ranks]) for c in cells])[F.col("cell")]
    hit = F.filter(wanted, lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n")))
    rows = pos.withColumn("hit", hit).filter(F.size("hit") > 0).select("cell", "value", "hit").collect()  # at most one a rank
    return {(cells[r["cell"]].column, cells[r["cell"]].below + k): r["value"] for r in rows for k in r["hit"]}


def exact_quantile_pairs(df: DataFrame, cols: list[str], probs: list[float]) -> tuple[dict[str, int], dict]:
    """(rows of each column, {(column, rank): value} for the ranks floor and ceil of (n - 1) * prob), without sorting a column.

    A pass of mergeable sketches names two values around each rank, a counting pass tells exactly
    how many rows lie before, on and between them; only the cell that holds a rank is looked at
    again. The sketch decides how fast cells shrink, the counts decide the result. A cell of at
    most ``CELL_ROWS`` rows is sorted by one task; one still larger after ``MAX_ROUNDS`` (no
    sketch of distinct values does that) is summed over range partitions. What is shuffled does
    not depend on the number of distinct values.
    """
    cells = [_Cell(c, None, None, 0, 0, []) for c in cols]
    near = _around([float(p) for p in probs])
    first = df.agg(*[x for i, c in enumerate(cells) for x in (F.count(c.value()).alias(f"n{i}"), _sketch(c, near).alias(f"s{i}"))]).first()
    edges = [_edges(first[f"s{i}"]) for i in range(len(cells))]
    totals = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    for c in cells:
        c.n = totals[c.column]
        c.ranks = sorted({k for p in probs for x in [(c.n - 1) * float(p)] for k in (math.floor(x), math.ceil(x))}) if c.n else []
    found, small, large = {}, [], [(c, e) for c, e in zip(cells, edges) if c.n]
    for _ in range(MAX_ROUNDS):
        small += [c for c, _ in large if c.n <= CELL_ROWS]
        large = [(c, e) for c, e in large if c.n > CELL_ROWS]
        if not large:
            break
        new, rest = _refine(df, *map(list, zip(*large)))
        found.update(new)
        more = [c for c in rest if c.n > CELL_ROWS]
        small += [c for c in rest if c.n <= CELL_ROWS]
        row = df.agg(*[_sketch(c, c.probs()).alias(f"s{i}") for i, c in enumerate(more)]).first() if more else None
        large = [(c, _edges(row[f"s{i}"])) for i, c in enumerate(more)]
    for left in (small, [c for c, _ in large]):
        if left:
            found.update(_resolve(df, left))
    return totals, found


def quantiles(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact") -> DataFrame:
    """Linearly interpolated quantiles (numpy 'linear' = DuckDB quantile_cont) per column.

    ``exact``: the values at positions floor/ceil((n-1)q), found by ``exact_quantile_pairs``
    in a few aggregating passes over ``df`` (three up to about 10^8 rows, five up to 10^11).
    ``approx``: ``percentile_approx`` sketches (one pass, bounded memory).

    Returns (column, prob, value); nulls are ignored; empty column -> null. A position between
    two equal values gives that value, one beside an infinite value what IEEE arithmetic gives.
    """
    if method == "approx":
        wide = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(probs), 100000).alias(f"q{i}")
                        for i, c in enumerate(cols)])
        parts = [F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"), F.col(f"q{i}")[j].alias("value"))
                 for i, c in enumerate(cols) for j, p in enumerate(probs)]
        return wide.select(F.inline(F.array(*parts)))
    totals, found = exact_quantile_pairs(df, cols, probs)
    rows = []
    for c in cols:
        for p in probs:
            if not totals[c]:
                rows.append((c, float(p), None))
                continue
            x = (totals[c] - 1) * float(p)
            lo, hi = found[(c, math.floor(x))], found[(c, math.ceil(x))]
            rows.append((c, float(p), lo if lo == hi else lo + (x - math.floor(x)) * (hi - lo)))
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")
