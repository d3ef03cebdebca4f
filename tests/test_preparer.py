"""The fitted table preparation: numpy on the train rows, a saved pipeline, new rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from retainly.operators import preparer as P


def train(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 9 == 0 else float("nan") if i % 13 == 0 else float(rng.standard_t(2)), "abc"[i % 3] if i % 7 else None, i * 3) for i in range(200)]
    return rows, spark.createDataFrame(rows, "k long, x double, c string, n long")


@pytest.mark.parametrize("scale", [False, True])
def test_reloaded_pipeline_prepares_new_rows(spark, tmp_path, scale):
    rows, df = train(spark)
    stage = P.TablePreparer(numeric=["x"], categories=["c"], integers=["n"], scale=scale)
    fitted = Pipeline(stages=[stage]).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    model = PipelineModel.load(str(tmp_path / "m"))
    new = spark.createDataFrame([(1, None, "b", 5), (2, 1e9, "z", 6), (3, -1e9, None, 7), (4, 0.25, "a", 8), (5, float("nan"), "c", None)],
                                "k long, x double, c string, n long")
    got = {r.k: r for r in model.transform(new).collect()}
    x = np.array([r[1] for r in rows if r[1] is not None and not np.isnan(r[1])])
    q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    want = np.array([med, hi, lo, 0.25, med])
    if scale:
        full = np.clip([med if r[1] is None or np.isnan(r[1]) else r[1] for r in rows], lo, hi)
        want = (want - full.mean()) / full.std()
    assert np.allclose([got[i].x for i in range(1, 6)], want)
    assert [got[i].c for i in range(1, 6)] == [1, -1, -1, 0, 2]
    assert dict(model.transform(new).dtypes)["n"] == "smallint" and [got[i].n for i in range(1, 6)] == [5, 6, 7, 8, None]
    a, b = (m.transform(df).orderBy("k").collect() for m in (fitted, model))
    assert a == b


def test_many_categories_are_joined(spark, monkeypatch):
    _, df = train(spark)
    plain = P.TablePreparer(categories=["c"]).fit(df).transform(df).orderBy("k").collect()
    monkeypatch.setattr(P, "MAP_VALUES", 2)
    joined = P.TablePreparer(categories=["c"]).fit(df).transform(df).orderBy("k")
    assert [(r.k, r.c) for r in joined.collect()] == [(r.k, r.c) for r in plain]


def test_empty_train_rows(spark):
    _, df = train(spark)
    model = P.TablePreparer(numeric=["x"], categories=["c"], scale=True).fit(df.limit(0))
    assert {r.c for r in model.transform(df).collect()} == {-1}
    assert model.transform(df).filter("x IS NULL").count() == df.filter("x IS NULL OR isnan(x)").count()
    assert model.transform(df.limit(0)).count() == 0
