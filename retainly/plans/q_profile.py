"""Bindings of profiling / data-quality scans (2.A) and cleaning (2.B)."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ..operators import clean as CL
from ..operators import profile as PR
from ..operators.preparer import TablePreparer
from ..session import ensure_checkpoint_dir
from ..sources import views as V
from ..sources.tables import TABLES, load_table
from .oracle_views import with_views
from .q_features import STRAT_SQL, strat
from .registry import register

CB_TYPES = [("c_custkey", "bigint"), ("n_orders", "bigint"), ("spend", "double"), ("recency_days", "bigint"),
            ("tenure_days", "bigint"), ("n_urgent", "bigint"), ("c_mktsegment", "string"), ("c_nationkey", "int"),
            ("c_acctbal", "double"), ("churn", "int")]
PROC_COLS = ["c_custkey", "n_orders", "spend", "recency_days", "tenure_days", "n_urgent", "c_mktsegment",
             "c_nationkey", "c_acctbal", "churn"]
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TABLE_NCOLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
               "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}
Q = '"column"'
PII_FIELDS = ["c_name", "c_phone", "c_address", "email", "customerID"]


def _round_doubles(df, digits=6):
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema.fields])


@register("profile_shape", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, {TABLE_NCOLS[t]} AS n_columns FROM {t}" for t in TABLES))
def q_profile_shape(spark, sf):
    return PR.profile_shape({t: load_table(spark, sf, t) for t in TABLES})


@register("profile_nonnull", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS {Q}, '{t}' AS dtype, count({c}) AS non_null FROM churn_base" for c, t in CB_TYPES), "CHURN_BASE"))
def q_profile_nonnull(spark, sf):
    return PR.profile_nonnull(V.churn_base(spark, sf))


def _null_union(view, cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS {Q}, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
        f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / nullif(count(*), 0), 2) AS pct_missing FROM {view}" for c in cols)


@register("missing_values", with_views(f"""
SELECT {Q}, n_missing, CAST(pct_missing AS DOUBLE) AS pct_missing FROM ({_null_union('churn_base', [c for c, _ in CB_TYPES])})
WHERE n_missing > 0""", "CHURN_BASE"))
def q_missing_values(spark, sf):
    return PR.missing_values(V.churn_base(spark, sf))


@register("class_distribution", with_views("""
SELECT churn AS label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM churn_base), 2)::DOUBLE AS pct
FROM churn_base GROUP BY churn""", "CHURN_BASE"))
def q_class_distribution(spark, sf):
    return PR.class_distribution(V.churn_base(spark, sf), "churn")


@register("describe_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS {Q}, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem" for c in LINE_NUM))
def q_describe_numeric(spark, sf):
    return _round_doubles(PR.describe_numeric(load_table(spark, sf, "lineitem"), LINE_NUM))


@register("pii_columns", f"""
SELECT table_name, column_name, keyword
FROM information_schema.columns, (SELECT unnest({PR.PII_KEYWORDS!r}) AS keyword)
WHERE table_name IN ({", ".join(repr(t) for t in TABLES)}) AND contains(lower(column_name), keyword)""")
def q_pii_columns(spark, sf):
    return PR.pii_columns({t: load_table(spark, sf, t) for t in TABLES})


PII_SCAN = {"documents": ["text", "lang", "source"], "conversations": ["role", "text"], "customer": ["c_name", "c_mktsegment"]}


def _pii_scan_sql():
    parts = []
    for t, cols in PII_SCAN.items():
        for c in cols:
            for n, p in PR.PII_VALUE_PATTERNS.items():
                parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{n}' AS pattern, "
                             f"count(*) FILTER (WHERE regexp_matches({c}, '{p}')) AS n_matching FROM {t}")
    return " UNION ALL ".join(parts)


@register("pii_scan", _pii_scan_sql())
def q_pii_scan(spark, sf):
    from ..functions.checks import union_all
    return union_all([PR.pii_scan(load_table(spark, sf, t), cols, table=t) for t, cols in PII_SCAN.items()])


CUSTOMER_EXPECTED = ["c_custkey", "c_name", "c_address", "c_nationkey", "c_phone", "c_acctbal", "c_mktsegment"]


@register("check_schema", f"""
WITH e AS (SELECT unnest({CUSTOMER_EXPECTED!r}) AS c),
a AS (SELECT column_name AS c FROM information_schema.columns WHERE table_name = 'customer'),
m AS (SELECT c FROM e WHERE c NOT IN (SELECT c FROM a))
SELECT 'schema_missing' AS "check", c AS subject, 0.0::DOUBLE AS actual, 'present' AS expected, 'FAILED' AS status FROM m
UNION ALL SELECT 'schema_extra', c, 1.0::DOUBLE, 'absent', 'WARNING' FROM a WHERE c NOT IN (SELECT c FROM e) AND (SELECT count(*) FROM m) = 0
UNION ALL SELECT 'schema_present', c, 1.0::DOUBLE, 'present', 'PASSED' FROM e WHERE c IN (SELECT c FROM a)""")
def q_check_schema(spark, sf):
    return PR.check_schema(load_table(spark, sf, "customer"), CUSTOMER_EXPECTED)


@register("check_types", """
SELECT 'numeric_coercion' AS "check", 'props.k' AS subject, CAST(b0 AS DOUBLE) AS actual, '<= 20 failures' AS expected,
       CASE WHEN b0 <= 20 THEN 'PASSED' ELSE 'FAILED' END AS status FROM a
UNION ALL SELECT 'numeric_coercion', 'event_type', CAST(b1 AS DOUBLE), '<= 20 failures', CASE WHEN b1 <= 20 THEN 'PASSED' ELSE 'FAILED' END FROM a
UNION ALL SELECT 'numeric_type', 'value', 1.0, 'bigint/int/double/float', 'PASSED'
""".replace("FROM a\nUNION ALL SELECT 'numeric_coercion'", "FROM a\nUNION ALL SELECT 'numeric_coercion'")
    .join(["WITH a AS (SELECT count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NULL) AS b0, "
           "count(*) FILTER (WHERE TRY_CAST(event_type AS DOUBLE) IS NULL) AS b1 FROM events)", ""]))
def q_check_types(spark, sf):
    ev = load_table(spark, sf, "events")
    return PR.check_types(ev, {"props.k": F.get_json_object("props", "$.k"), "event_type": F.col("event_type")}, ["value"])


@register("check_missing_threshold", with_views(f"""
SELECT 'missing_threshold' AS "check", {Q} AS subject, CAST(pct_missing AS DOUBLE) AS actual, '<= 1.0' AS expected,
       CASE WHEN pct_missing IS NULL THEN 'UNKNOWN' WHEN pct_missing <= 1.0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM ({_null_union('churn_base', [c for c, _ in CB_TYPES])})""", "CHURN_BASE"))
def q_check_missing_threshold(spark, sf):
    return PR.check_missing_threshold(V.churn_base(spark, sf), 1.0)


@register("check_target_domain", with_views("""
SELECT 'target_domain' AS "check", 'churn' AS subject, CAST(count(*) FILTER (WHERE NOT coalesce(churn IN (0, 1), false)) AS DOUBLE) AS actual,
       'in [0, 1]' AS expected, CASE WHEN count(*) FILTER (WHERE NOT coalesce(churn IN (0, 1), false)) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM churn_base
UNION ALL SELECT 'target_positive_rate', 'churn', round(avg(CASE WHEN churn = 1 THEN 1.0 ELSE 0.0 END) * 100, 2), 'reported', 'PASSED' FROM churn_base""",
    "CHURN_BASE"))
def q_check_target_domain(spark, sf):
    return PR.check_target_domain(V.churn_base(spark, sf), "churn", [0, 1])


@register("check_no_nulls", with_views(f"""
SELECT 'no_nulls' AS "check", 'all_columns' AS subject, CAST(n AS DOUBLE) AS actual, '0' AS expected,
       CASE WHEN n = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT {' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in PROC_COLS)} AS n FROM processed)""", "PROCESSED"))
def q_check_no_nulls(spark, sf):
    return PR.check_no_nulls(V.processed(spark, sf))


@register("check_all_numeric", with_views("""
SELECT 'all_numeric' AS "check", coalesce(string_agg(column_name, ',' ORDER BY column_name), '-') AS subject,
       CAST(count(column_name) AS DOUBLE) AS actual, '0 string columns' AS expected,
       CASE WHEN count(column_name) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT column_name FROM (DESCRIBE processed) WHERE column_type = 'VARCHAR')""", "PROCESSED"))
def q_check_all_numeric(spark, sf):
    return PR.check_all_numeric(V.processed(spark, sf))


SCALE_COLS = ["n_orders", "spend", "recency_days", "tenure_days", "n_urgent", "c_acctbal"]


def _scaled_sql():
    cols = ", ".join(f"({c} - (SELECT avg({c}) FROM processed)) / coalesce(nullif((SELECT stddev_pop({c}) FROM processed), 0), 1.0) AS {c}"
                     for c in SCALE_COLS)
    return f"scaled AS (SELECT {cols} FROM processed)"


@register("check_scaling", with_views(" UNION ALL ".join(
    f"SELECT 'scaled_mean' AS \"check\", '{c}' AS subject, round(avg({c}), 6) + 0.0 AS actual, '|x| < 0.1' AS expected, "
    f"CASE WHEN abs(avg({c})) < 0.1 THEN 'PASSED' ELSE 'FAILED' END AS status FROM scaled "
    f"UNION ALL SELECT 'scaled_std', '{c}', round(stddev_samp({c}), 6), 'reported', 'PASSED' FROM scaled" for c in SCALE_COLS),
    "PROCESSED", extra=_scaled_sql()))
def q_check_scaling(spark, sf):
    p = V.processed(spark, sf)
    return PR.check_scaling(CL.standard_scale(p, SCALE_COLS), SCALE_COLS)


PART_STR = ["p_name", "p_brand", "p_type"]


@register("check_cardinality", " UNION ALL ".join(
    f"SELECT 'cardinality' AS \"check\", '{c}' AS subject, CAST(count(DISTINCT {c}) AS DOUBLE) AS actual, '<= 50' AS expected, "
    f"CASE WHEN count(DISTINCT {c}) <= 50 THEN 'PASSED' ELSE 'FAILED' END AS status FROM part" for c in PART_STR))
def q_check_cardinality(spark, sf):
    return PR.check_cardinality(load_table(spark, sf, "part"), PART_STR, 50)


@register("check_constant", with_views(" UNION ALL ".join(
    f"SELECT 'constant' AS \"check\", '{c}' AS subject, CAST(count({c}) > 0 AND min({c}) = max({c}) AS DOUBLE) AS actual, "
    f"'not constant' AS expected, CASE WHEN count({c}) > 0 AND min({c}) = max({c}) THEN 'FAILED' ELSE 'PASSED' END AS status "
    f"FROM processed" for c in PROC_COLS), "PROCESSED"))
def q_check_constant(spark, sf):
    return PR.check_constant(V.processed(spark, sf), PROC_COLS)


@register("check_pii_columns", with_views(f"""
SELECT 'pii_removed' AS "check", coalesce(string_agg(column_name, ','), '-') AS subject, CAST(count(column_name) AS DOUBLE) AS actual,
       '0 PII columns' AS expected, CASE WHEN count(column_name) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT column_name FROM (DESCRIBE processed) WHERE column_name IN ({", ".join(repr(x) for x in PII_FIELDS)}))""", "PROCESSED"))
def q_check_pii_columns(spark, sf):
    return PR.check_pii_columns(V.processed(spark, sf), PII_FIELDS)


@register("duplicates", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicates
FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)""")
def q_duplicates(spark, sf):
    return PR.duplicates(load_table(spark, sf, "documents"), ["text"])


@register("dedup_exact", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def q_dedup_exact(spark, sf):
    return PR.dedup_exact(load_table(spark, sf, "documents"), ["text"], "doc_id").select("doc_id", "lang", "source")


def _pii_counts_sql():
    parts = []
    for src in ("documents", "conversations"):
        for n, p in PR.PII_COUNT_PATTERNS.items():
            parts.append(f"SELECT '{src}' AS source, '{n}' AS pii_type, "
                         f"CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT) AS n_matches, "
                         f"count(*) FILTER (WHERE len(regexp_extract_all(text, '{p}')) > 0) AS n_rows FROM {src}")
    return " UNION ALL ".join(parts)


@register("pii_counts", _pii_counts_sql())
def q_pii_counts(spark, sf):
    return PR.pii_counts({"documents": load_table(spark, sf, "documents"),
                          "conversations": load_table(spark, sf, "conversations")})


AS_OF = "2024-02-01 00:00:00"
FRESH_SOURCES = [("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")]


@register("freshness", " UNION ALL ".join(
    f"SELECT '{t}' AS source, round((epoch(TIMESTAMP '{AS_OF}') - epoch(max({c}))) / 3600.0, 6) AS age_hours, "
    f"CASE WHEN (epoch(TIMESTAMP '{AS_OF}') - epoch(max({c}))) / 3600.0 <= 24 THEN 'FRESH' ELSE 'STALE' END AS status FROM {t}"
    for t, c in FRESH_SOURCES))
def q_freshness(spark, sf):
    return PR.freshness({t: (load_table(spark, sf, t), c) for t, c in FRESH_SOURCES}, AS_OF, 24.0)


# ---- 2.B cleaning ----

@register("impute_median", with_views(
    "SELECT c_custkey, round(spend, 6) AS spend, round(recency_days, 6) AS recency_days, round(tenure_days, 6) AS tenure_days FROM processed",
    "PROCESSED"))
def q_impute_median(spark, sf):
    return _round_doubles(CL.impute_median(V.churn_base(spark, sf), V.IMPUTED).select("c_custkey", *V.IMPUTED))


@register("encode_categoricals", with_views("""
SELECT c_custkey,
       CAST(coalesce((SELECT code FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM b WHERE c_mktsegment IS NOT NULL)) WHERE v = b.c_mktsegment), -1) AS INTEGER) AS c_mktsegment,
       CAST(coalesce((SELECT code FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT region AS v FROM b WHERE region IS NOT NULL)) WHERE v = b.region), -1) AS INTEGER) AS region
FROM b""", "CHURN_BASE", "REGION_DIM", extra="b AS (SELECT c_custkey, c_mktsegment, region FROM churn_base LEFT JOIN region_dim ON c_nationkey = n_nationkey)"))
def q_encode_categoricals(spark, sf):
    d = V.with_region(spark, sf, V.churn_base(spark, sf)).select("c_custkey", "c_mktsegment", "region")
    return CL.encode_categoricals(d, ["c_mktsegment", "region"])


@register("standard_scale", f"""
SELECT l_orderkey, l_linenumber, {", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / coalesce(nullif((SELECT stddev_pop({c}) FROM lineitem), 0), 1.0), 6) AS {c}"
    for c in LINE_NUM)} FROM lineitem""")
def q_standard_scale(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE_NUM)
    return _round_doubles(CL.standard_scale(li, LINE_NUM))


def _outlier_sql():
    parts = []
    for c in LINE_NUM:
        parts.append(f"""SELECT '{c}' AS {Q}, q1, q3, lower, upper, count(*) FILTER (WHERE {c} < lower) AS n_below,
  count(*) FILTER (WHERE {c} > upper) AS n_above, avg(greatest(lower, least(upper, {c}))) AS capped_mean
FROM lineitem, (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
                FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem))
GROUP BY q1, q3, lower, upper""")
    body = " UNION ALL ".join(parts)
    return (f"SELECT {Q}, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper, "
            f"n_below, n_above, round(capped_mean, 6) AS capped_mean FROM ({body})")


@register("outlier_iqr_cap", _outlier_sql())
def q_outlier_iqr_cap(spark, sf):
    return _round_doubles(CL.outlier_report(load_table(spark, sf, "lineitem"), LINE_NUM))


def _narrow_sql():
    parts = []
    for c, t in CB_TYPES:
        if t in ("bigint", "int"):
            expr = (f"CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' WHEN min({c}) > -32768 AND max({c}) < 32767 "
                    f"THEN 'smallint' WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE '{t}' END")
        elif t == "double":
            parts.append(f"SELECT '{c}' AS {Q}, '{t}' AS current_type, 'float' AS narrow_type")
            continue
        else:
            expr = f"CASE WHEN count(DISTINCT {c}) < count(*) * 0.5 THEN 'category' ELSE 'string' END"
        parts.append(f"SELECT '{c}' AS {Q}, '{t}' AS current_type, {expr} AS narrow_type FROM churn_base")
    return with_views(" UNION ALL ".join(parts), "CHURN_BASE")


@register("narrow_types", _narrow_sql())
def q_narrow_types(spark, sf):
    return CL.narrow_types(V.churn_base(spark, sf))


PARAM_NUM = ["n_orders", "spend", "c_acctbal"]


def _params_sql():
    parts = []
    for c in PARAM_NUM:
        parts.append(f"SELECT '{c}' AS {Q}, 'mean' AS param, round(avg({c}), 6) AS num_value, NULL::VARCHAR AS str_value FROM churn_base")
        parts.append(f"SELECT '{c}', 'scale', round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6), NULL FROM churn_base")
        parts.append(f"SELECT '{c}', 'var', round(var_pop({c}), 6), NULL FROM churn_base")
    parts.append("SELECT 'c_mktsegment', 'code', CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE), v "
                 "FROM (SELECT DISTINCT c_mktsegment AS v FROM churn_base WHERE c_mktsegment IS NOT NULL)")
    return with_views(" UNION ALL ".join(parts), "CHURN_BASE")


@register("preprocessor_params", _params_sql())
def q_preprocessor_params(spark, sf):
    return _round_doubles(CL.preprocessor_params(V.churn_base(spark, sf), PARAM_NUM, ["c_mktsegment"]))


PREP_NUM, PREP_INT = ["spend", "recency_days", "c_acctbal"], ["n_orders", "n_urgent", "c_nationkey"]


def _prepared_sql():
    """Fitted on the train split, applied to all customers."""
    train = "(SELECT * FROM strat WHERE split = 'train')"
    stats = ", ".join(f"quantile_cont({c}::DOUBLE, 0.25) AS q1_{c}, quantile_cont({c}::DOUBLE, 0.5) AS md_{c}, quantile_cont({c}::DOUBLE, 0.75) AS q3_{c}"
                      for c in PREP_NUM)
    capped = ", ".join(f"round(greatest(q1_{c} - 1.5 * (q3_{c} - q1_{c}), least(q3_{c} + 1.5 * (q3_{c} - q1_{c}), coalesce({c}::DOUBLE, md_{c}))), 6) AS {c}"
                       for c in PREP_NUM)
    return with_views(f"""SELECT c_custkey, {capped}, coalesce(code, -1) AS c_mktsegment, {", ".join(f"CAST({c} AS TINYINT) AS {c}" for c in PREP_INT)}
FROM churn_base CROSS JOIN fitted LEFT JOIN codes ON v = c_mktsegment""", "CHURN_BASE", extra=STRAT_SQL + f""",
fitted AS (SELECT {stats} FROM {train}),
codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
          FROM (SELECT DISTINCT c_mktsegment AS v FROM {train} WHERE c_mktsegment IS NOT NULL))""")


@register("prepared_table", _prepared_sql())
def q_prepared_table(spark, sf):
    """The capped, coded and narrowed table, by a pipeline fitted on the train split, saved and read again."""
    cols = ["c_custkey", *PREP_NUM, "c_mktsegment", *PREP_INT]
    stage = TablePreparer(numeric=PREP_NUM, categories=["c_mktsegment"], integers=PREP_INT)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    Pipeline(stages=[stage]).fit(strat(spark, sf).filter("split = 'train'").select(*cols)).write().save(path)
    return _round_doubles(PipelineModel.load(path).transform(V.churn_base(spark, sf).select(*cols)))
