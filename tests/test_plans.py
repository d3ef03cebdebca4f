"""Physical-plan properties of headline queries (column pruning, fixed-size shuffle keys, no single-task window)."""

import contextlib
import io
import re

from retainly.plans.registry import load_all

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_flagship_reads_only_needed_columns(spark, monkeypatch):
    monkeypatch.setenv("RETAINLY_MATERIALIZE_VIEWS", "0")
    txt = plan_text(load_all()["campaign_cost"].build(spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", txt)
    assert "struct<c_custkey:bigint,c_acctbal:double>" in schemas
    orders = [s for s in schemas if "o_" in s]
    assert orders and all(set(re.findall(r"(o_\w+):", s)) <= {"o_custkey", "o_orderdate"} for s in orders)
    assert "CartesianProduct" not in txt and "BroadcastNestedLoopJoin" not in txt


def test_dedup_shuffles_digests_not_texts(spark):
    txt = plan_text(load_all()["duplicates"].build(spark, SF))
    assert "md5(" in txt and re.search(r"hashpartitioning\(_groupingexpression", txt)
    assert "ReadSchema: struct<text:string>" in txt


def test_no_unpartitioned_window_over_rows(spark):
    # the per-class split ranks come from the global numbering, not from a window over the label
    txt = plan_text(load_all()["stratified_split"].build(spark, SF))
    assert "windowspecdefinition(churn" not in txt
