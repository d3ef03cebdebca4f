"""Cleaning, encoding and scaling.

Fitting works like a pyspark.ml ``fit``: the statistics are computed by one
distributed aggregation whose result is bounded by the number of columns
(never by the rows) and returned to the driver as literals. Code maps,
which grow with cardinality, stay DataFrames; the planner chooses how they
join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantiles


def impute_median(df: DataFrame, cols: list[str], coerce: bool = False, quantile_method: str = "exact",
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the column's interpolated median in ``fit_on`` (the train split) or in ``df``,
    optionally coercing strings to double first."""
    def coerced(x):
        return x.withColumns({c: F.col(c).try_cast("double") for c in cols}) if coerce else x

    d = coerced(df)
    med = fit_quantiles(coerced(fit_on) if fit_on is not None else d, cols, [0.5], quantile_method)
    return d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[(c, 0.5)]).cast("double")) for c in cols})


def fit_quantiles(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact") -> dict:
    """{(column, prob): value}; the result has len(cols) * len(probs) rows."""
    return {(r["column"], r["prob"]): r["value"] for r in quantiles(df, cols, probs, method).collect()}


def category_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code) with code = position of the value in sorted order (0-based).

    Built from the distinct values only, numbered by the global range-partitioned
    numbering (no window holding a whole column's distinct set in one task).
    """
    from ..functions.ranking import rank_within_groups
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                        for c in cols]))).filter(F.col("value").isNotNull()).distinct()
    ranked = rank_within_groups(long, ["column"], ["value"], out="_r")
    return ranked.select("column", "value", (F.col("_r") - 1).cast("int").alias("code"))


def encode_categoricals(df: DataFrame, multi_class: list[str], binary_maps: dict[str, dict] | None = None,
                        drop: list[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Binary maps (unmapped -> null) and sorted-order codes for multi-class columns (null or not in ``fit_on`` -> -1).

    The codes come from the values of ``fit_on`` (the train split) or of ``df``. How the code table joins
    is left to the planner: broadcast by its size, or a sort-merge join whose hot values AQE splits.
    """
    out = df.drop(*(drop or []))
    for c, m in (binary_maps or {}).items():
        items = []
        for k, v in m.items():
            items += [F.lit(k), F.lit(v)]
        out = out.withColumn(c, F.try_element_at(F.create_map(*items), F.col(c)))
    if not multi_class:
        return out
    codes = category_codes(out if fit_on is None else fit_on, multi_class)
    for c in multi_class:
        m = codes.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = (out.join(m, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
               .withColumn(c, F.coalesce(F.col(f"_c_{c}"), F.lit(-1)))
               .drop(f"_v_{c}", f"_c_{c}"))
    return out


def scaler_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population std per column (zero variance -> scale 1)."""
    return df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"),
                                               F.var_pop(c).alias(f"{c}__var"))])


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std_pop, fitted on ``fit_on`` (e.g. the train split) or on ``df``.

    Population std as in the reference; pyspark.ml StandardScaler uses the
    sample std and therefore differs.
    """
    st = scaler_stats(fit_on if fit_on is not None else df, cols).first()
    out = {}
    for c in cols:
        mean, std = st[f"{c}__mean"], st[f"{c}__std"]
        scale = 1.0 if (std is None or std == 0) else std
        out[c] = (F.col(c) - F.lit(mean)) / F.lit(scale)
    return df.withColumns(out)


def iqr_bounds(df: DataFrame, cols: list[str], k: float = 1.5, quantile_method: str = "exact") -> DataFrame:
    q = quantiles(df, cols, [0.25, 0.75], quantile_method)
    w = q.groupBy("column").agg(F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
                                F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
    return w.withColumns({"lower": F.col("q1") - k * (F.col("q3") - F.col("q1")),
                          "upper": F.col("q3") + k * (F.col("q3") - F.col("q1"))})


def outlier_iqr_cap(df: DataFrame, cols: list[str], k: float = 1.5, quantile_method: str = "exact") -> DataFrame:
    """Winsorise each column to [Q1 - k IQR, Q3 + k IQR]; bounds enter as scalar subqueries."""
    b = {r["column"]: r for r in iqr_bounds(df, cols, k, quantile_method).collect()}  # one row per column
    out = {}
    for c in cols:
        lo, hi = F.lit(b[c]["lower"]).cast("double"), F.lit(b[c]["upper"]).cast("double")
        out[c] = F.greatest(lo, F.least(hi, F.col(c).cast("double")))
    return df.withColumns(out)


def outlier_report(df: DataFrame, cols: list[str], k: float = 1.5, quantile_method: str = "exact") -> DataFrame:
    """Per column: quartiles, bounds, rows below/above, mean after capping (one pass for all columns)."""
    b = iqr_bounds(df, cols, k, quantile_method)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                        for c in cols])))
    j = long.join(F.broadcast(b), "column")  # b has one row per column
    capped = F.greatest(F.col("lower"), F.least(F.col("upper"), F.col("value")))
    return (j.groupBy("column", "q1", "q3", "lower", "upper")
            .agg(F.count_if(F.col("value") < F.col("lower")).alias("n_below"),
                 F.count_if(F.col("value") > F.col("upper")).alias("n_above"),
                 F.avg(capped).alias("capped_mean")))


INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647)]


def narrow_types(df: DataFrame, category_ratio: float = 0.5) -> DataFrame:
    """Narrowest type per column from one aggregation: strict int bounds, double -> float,
    low-cardinality strings -> dictionary ('category')."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        t = f.dataType.simpleString()
        if t in ("tinyint", "smallint", "int", "bigint"):
            aggs += [F.min(f.name).alias(f"lo{i}"), F.max(f.name).alias(f"hi{i}")]
        elif t == "string":
            aggs += [F.count_distinct(f.name).alias(f"d{i}")]
    wide = df.agg(*aggs)
    structs = []
    for i, f in enumerate(fields):
        t = f.dataType.simpleString()
        if t in ("tinyint", "smallint", "int", "bigint"):
            lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
            chosen = F.lit(t)
            for name, a, b in reversed(INT_RANGES):
                chosen = F.when((lo > a) & (hi < b), F.lit(name)).otherwise(chosen)
        elif t == "double":
            chosen = F.lit("float")
        elif t == "string":
            chosen = F.when(F.col(f"d{i}") < F.col("_n") * category_ratio, F.lit("category")).otherwise(F.lit("string"))
        else:
            chosen = F.lit(t)
        structs.append(F.struct(F.lit(f.name).alias("column"), F.lit(t).alias("current_type"), chosen.alias("narrow_type")))
    return wide.select(F.inline(F.array(*structs)))


def apply_narrow_types(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Cast per the ``narrow_types`` plan (category stays string: Parquet dictionary-encodes it)."""
    mapping = {r["column"]: r["narrow_type"] for r in plan.collect()}  # one row per column (schema-sized)
    return df.withColumns({c: F.col(c).cast(t) for c, t in mapping.items() if t not in ("category", "string")})


def preprocessor_params(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Long parameter table (column, param, num_value, str_value): scaler mean/scale/var and category codes."""
    st = scaler_stats(df, numeric)
    num = st.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("param"), v.alias("num_value"), F.lit(None).cast("string").alias("str_value"))
        for c in numeric for p, v in (
            ("mean", F.col(f"{c}__mean")),
            ("scale", F.when(F.col(f"{c}__std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__std"))),
            ("var", F.col(f"{c}__var")))])))
    codes = category_codes(df, categorical).select(
        "column", F.lit("code").alias("param"), F.col("code").cast("double").alias("num_value"), F.col("value").alias("str_value"))
    return num.unionByName(codes)


def save_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)
