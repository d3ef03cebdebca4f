"""The pipeline against a brute-force version of its stages, and the registration of the queries."""

import os
import re
import subprocess
import sys

import corpus_pipeline
from retainly.llm import queries, secret_scan

from . import brute, odd
from .test_scores import brute_counts
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def brute_texts(spark, rows, items):
    hosts, kept = {}, []
    for r in rows:
        n, _, _, _, rep = brute_counts(r.text)
        bad = n < 50 or 100 * rep > 50 * n
        hosts.setdefault(r.source, []).append(bad)
        if not bad:
            kept.append(r)
    rates = [sum(v) / len(v) for v in hosts.values()]
    m = sum(rates) / len(rates)
    var = sum((x - m) ** 2 for x in rates) / len(rates)
    weight = max(1.0, m * (1 - m) / var - 1) if var else 1.0
    kept = [r for r in kept if (sum(hosts[r.source]) + m * weight) / (len(hosts[r.source]) + weight) <= 0.5]
    first = {d for d, _, c in brute.jaccard_components([(r.doc_id, r.text) for r in kept]) if d == c}
    kept = [r for r in kept if r.doc_id in first]
    bad = {d for d, _ in brute.leaks([(r.doc_id, r.text) for r in kept], items)}
    return [(r.doc_id, re.sub(r'(token = ")[0-9a-f]{40}', rf"\1{secret_scan.MASK}", r.text)) for r in kept if r.doc_id not in bad]


def test_pipeline_equals_brute_force(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    used, bound = check_packing(got, brute_texts(spark, rows, items), 2048)
    assert used <= bound + 1


def test_stages_keep_columns_and_survive_odd_rows(spark):
    good = [(5000 + i, " ".join(f"v{(i * 37 + k * 11) % 997}" for k in range(80)) + f' token = "{i:040x}"', None, "src0") for i in range(120)]
    docs = odd.frame(spark, odd.rows() + good)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = corpus_pipeline.stored(out, "test")
        assert docs.count() <= len(odd.rows()) + len(good)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_empty_table_through_all_stages(spark):
    docs = odd.frame(spark, [], clashes=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.count() == 0


def test_one_query_for_each_operator():
    import __spark_entry__ as E
    q = E.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in q) == 1
    assert "pipeline" in q and set(queries.ORACLES) <= set(E.oracle_sql())


def test_operators_import_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import retainly.llm.queries, corpus_pipeline; from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
