"""Profiling and data-quality scans.

Per-column work is ONE aggregation over all columns followed by an unpivot;
schema-only checks read no data. Validators return check rows
(check, subject, actual, expected, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import FAILED, PASSED, WARNING, check_row, check_rows, union_all
from ..functions.stats import column_stats, numeric_columns, quantiles

# ---- fixed values (reference keyword list and patterns) ----
PII_KEYWORDS = ["email", "phone", "ssn", "social", "password", "credit_card", "id", "name"]
PII_VALUE_PATTERNS = {
    "Email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "Phone": r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "SSN": r"\d{3}-\d{2}-\d{4}",
}
PII_COUNT_PATTERNS = {
    "email": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "phone": r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "credit_card": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
}


def profile_shape(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns); counts come from Parquet metadata-friendly ``count``."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        for name, df in tables.items()]
    return union_all(parts)


def profile_nonnull(df: DataFrame) -> DataFrame:
    """Per column: Spark type and non-null count, one aggregation."""
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    structs = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                        F.col(f"c{i}").alias("non_null")) for i, f in enumerate(df.schema.fields)]
    return wide.select(F.inline(F.array(*structs)))


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """String -> double with bad values as null (``try_cast``; plain cast raises under ANSI)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols})


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_missing, pct_missing rounded to 2) for every column, one aggregation."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), F.col(f"m{i}").alias("n_missing"))
               for i, c in enumerate(cols)]
    long = wide.select(F.inline(F.array(*structs)))
    return long.withColumn("pct_missing", F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("n_rows")), 2))


def missing_values(df: DataFrame, coerce: list[str] | None = None) -> DataFrame:
    """Columns with at least one null after numeric coercion of ``coerce`` columns."""
    d = coerce_numeric(df, coerce) if coerce else df
    return null_profile(d).filter(F.col("n_missing") > 0).select("column", "n_missing", "pct_missing")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Counts per label value and share in % (2 dp); total via a scalar subquery, no global window."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pct", F.round(F.col("n") * 100.0 / total, 2)))


def describe_numeric(df: DataFrame, cols: list[str] | None = None, quantile_method: str = "exact") -> DataFrame:
    """count, mean, std (ddof=1), min, 25/50/75 % (linear interpolation), max per column."""
    cols = cols or numeric_columns(df)
    basic = column_stats(df, cols, {"count": F.count, "mean": F.avg, "std": F.stddev_samp,
                                    "min": lambda c: F.min(c.cast("double")), "max": lambda c: F.max(c.cast("double"))})
    q = quantiles(df, cols, [0.25, 0.5, 0.75], quantile_method)
    qw = q.groupBy("column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
                                   for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return basic.join(qw, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def pii_columns(schemas: dict[str, DataFrame], keywords=PII_KEYWORDS) -> DataFrame:
    """Column names containing a PII keyword (lower-cased substring test). Reads schemas only."""
    rows = [(t, c, k) for t, df in schemas.items() for c in df.columns for k in keywords if k in c.lower()]
    spark = next(iter(schemas.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, keyword string")


def pii_scan(df: DataFrame, cols: list[str], patterns: dict[str, str] = PII_VALUE_PATTERNS,
             table: str = "") -> DataFrame:
    """Rows whose value matches each PII pattern, per (column, pattern), over the WHOLE table in one pass."""
    aggs = [F.count_if(F.col(c).rlike(p)).alias(f"m{i}_{j}") for i, c in enumerate(cols) for j, p in enumerate(patterns.values())]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(n).alias("pattern"),
                        F.col(f"m{i}_{j}").alias("n_matching"))
               for i, c in enumerate(cols) for j, n in enumerate(patterns)]
    return wide.select(F.inline(F.array(*structs)))


def check_schema(df: DataFrame, expected: list[str]) -> DataFrame:
    """Missing expected columns FAILED; extra columns WARNING (reported only when none is missing)."""
    actual = df.columns
    missing = [c for c in expected if c not in actual]
    extra = [c for c in actual if c not in expected]
    rows = [("schema_missing", c, 0.0, "present", FAILED) for c in missing]
    if not missing:
        rows += [("schema_extra", c, 1.0, "absent", WARNING) for c in extra]
    rows += [("schema_present", c, 1.0, "present", PASSED) for c in expected if c in actual]
    return df.sparkSession.createDataFrame(rows, "check string, subject string, actual double, expected string, status string")


def check_types(df: DataFrame, coerce: dict[str, Column], numeric_required: list[str], max_bad: int = 20) -> DataFrame:
    """Values failing numeric coercion per expression (> ``max_bad`` FAILED) and required numeric types."""
    items = list(coerce.items())
    a = df.agg(*[F.count_if(e.try_cast("double").isNull()).alias(f"b{i}") for i, (_, e) in enumerate(items)])
    specs = [("numeric_coercion", name, F.col(f"b{i}"), f"<= {max_bad} failures", F.col(f"b{i}") <= max_bad)
             for i, (name, _) in enumerate(items)]
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    for c in numeric_required:
        ok = types.get(c, "").split("(")[0] in ("bigint", "int", "double", "float")
        specs.append(("numeric_type", c, F.lit(1.0 if ok else 0.0), "bigint/int/double/float", F.lit(ok)))
    return check_rows(a, specs)


def check_missing_threshold(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Every column's null % (2 dp) against ``threshold`` (strictly greater fails)."""
    prof = null_profile(df)
    return check_row(prof, "missing_threshold", F.col("column"), F.col("pct_missing"), f"<= {threshold}",
                     F.col("pct_missing") <= threshold)


def check_target_domain(df: DataFrame, label: str, allowed: list) -> DataFrame:
    a = df.agg(F.count_if(~F.coalesce(F.col(label).isin(*allowed), F.lit(False))).alias("bad"),
               F.avg(F.when(F.col(label) == allowed[-1], 1.0).otherwise(0.0)).alias("rate"))
    return check_rows(a, [
        ("target_domain", label, F.col("bad"), f"in {allowed}", F.col("bad") == 0),
        ("target_positive_rate", label, F.round(F.col("rate") * 100, 2), "reported", F.lit(True)),
    ])


def check_no_nulls(df: DataFrame) -> DataFrame:
    a = df.agg(sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0)).alias("n"))
    return check_row(a, "no_nulls", "all_columns", F.col("n"), "0", F.col("n") == 0)


def check_all_numeric(df: DataFrame) -> DataFrame:
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    one = df.sparkSession.range(1)
    return check_row(one, "all_numeric", ",".join(strings) or "-", F.lit(float(len(strings))), "0 string columns",
                     F.lit(len(strings) == 0))


def check_scaling(df: DataFrame, cols: list[str], max_abs_mean: float = 0.1) -> DataFrame:
    """Mean and sample std of scaled columns; |mean| < ``max_abs_mean`` passes."""
    wide = df.agg(*[x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))])
    return check_rows(wide, [
        x for i, c in enumerate(cols) for x in (
            ("scaled_mean", c, F.round(F.col(f"m{i}"), 6) + 0.0, f"|x| < {max_abs_mean}", F.abs(F.col(f"m{i}")) < max_abs_mean),
            ("scaled_std", c, F.round(F.col(f"s{i}"), 6), "reported", F.lit(True)))])


def check_cardinality(df: DataFrame, cols: list[str] | None = None, max_unique: int = 50, exact: bool = True) -> DataFrame:
    """Distinct count of string columns; above ``max_unique`` fails (approx sketch at scale)."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    fn = F.count_distinct if exact else F.approx_count_distinct
    wide = df.agg(*[fn(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    return check_rows(wide, [("cardinality", c, F.col(f"d{i}"), f"<= {max_unique}", F.col(f"d{i}") <= max_unique)
                             for i, c in enumerate(cols)])


def check_constant(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A column is constant when min = max over >= 1 non-null value (all-null passes)."""
    cols = cols or df.columns
    wide = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.count(c).alias(f"n{i}"))])
    specs = []
    for i, c in enumerate(cols):
        const = (F.col(f"n{i}") > 0) & (F.col(f"lo{i}") == F.col(f"hi{i}"))
        specs.append(("constant", c, const.cast("double"), "not constant", ~const))
    return check_rows(wide, specs)


def check_pii_columns(df: DataFrame, pii_fields: list[str]) -> DataFrame:
    hit = [c for c in pii_fields if c in df.columns]
    one = df.sparkSession.range(1)
    return check_row(one, "pii_removed", ",".join(hit) or "-", F.lit(float(len(hit))), "0 PII columns", F.lit(len(hit) == 0))


def _row_digest(cols: list[str]):
    """Digest of the JSON text of the columns: names, quotes and nulls keep any two different rows apart."""
    return F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)]),
                           {"ignoreNullFields": "false"}))


def duplicates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows repeating an earlier identical row: sum(n - 1) over groups of equal rows.

    Rows are grouped by a 128-bit digest instead of their values, so the
    shuffle carries fixed-size keys.
    """
    g = df.groupBy(_row_digest(cols or df.columns).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                 F.sum(F.col("_n") - 1).alias("n_duplicates")).select(
        F.col("n_rows").cast("bigint"), "n_distinct", F.col("n_duplicates").cast("bigint"))


def dedup_exact(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """Keep the first row (smallest ``key``) of each group of identical ``cols`` values.

    One aggregation by digest; a hot duplicate group costs one slot per task
    (partial aggregation combines map-side), never a collected list. Rows
    without a key come after all others of their group.
    """
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(F.col(key).isNull(), F.col(key)))
    return df.groupBy(_row_digest(cols).alias("_d")).agg(first.alias("_row")).select("_row.*")


def pii_counts(texts: dict[str, DataFrame], text_col: str = "text", patterns: dict[str, str] = PII_COUNT_PATTERNS) -> DataFrame:
    """Regex match counts per (source, type) over whole texts; only counts leave the executors."""
    parts = []
    for src, df in texts.items():
        counts = df.select(*[F.regexp_count(F.col(text_col), F.lit(p)).alias(f"c{j}") for j, p in enumerate(patterns.values())])
        wide = counts.agg(*[F.sum(f"c{j}").alias(f"t{j}") for j in range(len(patterns))],
                          *[F.count_if(F.col(f"c{j}") > 0).alias(f"r{j}") for j in range(len(patterns))])
        parts.append(wide.select(F.inline(F.array(*[
            F.struct(F.lit(src).alias("source"), F.lit(n).alias("pii_type"),
                     F.coalesce(F.col(f"t{j}"), F.lit(0)).cast("bigint").alias("n_matches"),
                     F.col(f"r{j}").alias("n_rows")) for j, n in enumerate(patterns)]))))
    return union_all(parts)


def freshness(sources: dict[str, tuple[DataFrame, str]], as_of: str, max_age_hours: float = 24.0) -> DataFrame:
    """Age in hours of the newest timestamp of each source against an explicit ``as_of``."""
    parts = []
    for name, (df, ts) in sources.items():
        a = df.agg(F.max(ts).alias("_mx"))
        # difference of wall-clock values: no session time zone involved (NTZ stays NTZ)
        age = F.timestamp_diff("MICROSECOND", F.col("_mx").cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")) / 3.6e9
        parts.append(a.select(F.lit(name).alias("source"), F.round(age, 6).alias("age_hours")))
    u = union_all(parts)
    return u.withColumn("status", F.when(F.col("age_hours") <= max_age_hours, "FRESH").otherwise("STALE"))
