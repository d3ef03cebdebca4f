"""Bindings of the streaming re-aims (2.K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as PR
from ..sources import views as V
from ..sources.tables import load_table
from ..streaming import stream as ST
from .oracle_views import with_views
from .registry import register


@register("stream_score", with_views("SELECT c_custkey, p, pred FROM scored", "SCORED"))
def q_stream_score(spark, sf):
    # materialise the derived feature table into the shared folder, then score it as a file stream
    feats = V.churn_base(spark, sf)
    version = V.source_version(spark, sf)
    src = ST.stream_folder(spark, "churn-features", sf, version)
    feats.write.mode("ignore").parquet(src)
    stream = ST.score_stream(ST.folder_stream(spark, src, feats.schema)).select("c_custkey", "p", "pred")
    return ST.run_available_now(stream, ST.stream_folder(spark, "stream-score", sf, version))


@register("stream_drift", with_views("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, e.event_type, count(*) AS n,
       round(avg(value), 6) AS mean_value, round(b.bm, 6) AS baseline_mean,
       round(CASE WHEN b.bm = 0 THEN 0.0 ELSE abs((avg(value) - b.bm) / b.bm) * 100 END, 6) AS pct_shift,
       CAST(CASE WHEN b.bm = 0 THEN 0.0 ELSE abs((avg(value) - b.bm) / b.bm) * 100 END > 10.0 AS INTEGER) AS drift
FROM events e LEFT JOIN (
    SELECT event_type, avg(value) AS bm FROM events
    WHERE date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) < 10 GROUP BY event_type) b
  ON b.event_type = e.event_type
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY 1, 2, b.bm"""))
def q_stream_drift(spark, sf):
    ev = load_table(spark, sf, "events")
    first_day = ev.select(F.min(F.to_date("ts"))).scalar()
    baseline = (ev.filter(F.datediff(F.to_date("ts"), first_day) < 10)
                .groupBy("event_type").agg(F.avg("value").alias("baseline_mean")))
    folder = ST.stream_folder(spark, "stream-drift", sf, V.source_version(spark, sf, ["events"]))
    windows = ST.run_available_now(ST.drift_stream(ST.table_stream(spark, sf, "events", ev.schema)), folder)
    return ST.attach_baseline(windows, baseline)


def _pii_sql():
    cols = ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {n}" for n, p in PR.PII_COUNT_PATTERNS.items())
    return f"SELECT doc_id, {cols} FROM documents"


@register("stream_pii", _pii_sql())
def q_stream_pii(spark, sf):
    docs = load_table(spark, sf, "documents")
    folder = ST.stream_folder(spark, "stream-pii", sf, V.source_version(spark, sf, ["documents"]))
    return ST.run_available_now(ST.pii_stream(ST.table_stream(spark, sf, "documents", docs.schema)), folder)
