"""Table preparation as a ``pyspark.ml`` stage: fitted on the train rows, saved inside a ``PipelineModel``, applied to new rows.

Numeric columns: null (or NaN) to the train median, then to [Q1 - k IQR, Q3 + k IQR] of the train rows, then scaled by
the train mean and population std of the capped values where ``scale`` is set. Categories: their position
among the sorted train values, null and unseen ones -1. Other integers take the narrowest type that holds
the train rows; a value of a new row beyond it raises under ANSI rather than wrap.

The state is one JSON parameter: a few numbers a numeric column and the distinct values of every category column, which
have to fit the driver, as in ``StringIndexerModel``.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import category_codes, fit_quantiles, narrow_types

MAP_VALUES = 1000  # a column with more categories is joined with its codes instead of a literal map


class _Settings(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categories = Param(Params._dummy(), "categories", "category columns", TypeConverters.toListString)
    integers = Param(Params._dummy(), "integers", "integer columns to narrow", TypeConverters.toListString)
    k = Param(Params._dummy(), "k", "whisker length in IQRs", TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", "standardise the numeric columns", TypeConverters.toBoolean)


def _number(c: str):
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _capped(c: str, state: dict):
    s = state["numeric"][c]
    lit = {n: F.lit(s[n]).cast("double") for n in ("median", "lower", "upper")}
    return F.greatest(lit["lower"], F.least(lit["upper"], F.coalesce(_number(c), lit["median"])))


class TablePreparer(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """``fit`` gives a ``TablePreparerModel``; a numeric column without train values stays null."""

    @keyword_only
    def __init__(self, *, numeric=None, categories=None, integers=None, k=1.5, scale=False):
        super().__init__()
        self._setDefault(numeric=[], categories=[], integers=[], k=1.5, scale=False)
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "TablePreparerModel":
        numeric, categories, integers = (self.getOrDefault(p) for p in (self.numeric, self.categories, self.integers))
        state: dict = {"numeric": {}, "codes": {c: [] for c in categories}, "types": {}}
        if numeric:
            q = fit_quantiles(dataset.withColumns({c: _number(c) for c in numeric}), numeric, [0.25, 0.5, 0.75])
            for c in numeric:
                q1, median, q3 = (q[(c, p)] for p in (0.25, 0.5, 0.75))
                reach = None if q1 is None else self.getOrDefault(self.k) * (q3 - q1)
                state["numeric"][c] = {"median": median, "lower": None if q1 is None else q1 - reach,
                                       "upper": None if q1 is None else q3 + reach, "mean": 0.0, "std": 1.0}
            if self.getOrDefault(self.scale):
                got = dataset.agg(*[f(_capped(c, state)).alias(f"{n}{i}") for i, c in enumerate(numeric)
                                    for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
                for i, c in enumerate(numeric):
                    state["numeric"][c].update(mean=got[f"mean{i}"] or 0.0, std=got[f"std{i}"] or 1.0)
        if categories:
            for r in category_codes(dataset, categories).orderBy("column", "code").collect():
                state["codes"][r["column"]].append(r["value"])
        if integers:
            state["types"] = {r["column"]: r["narrow_type"] for r in narrow_types(dataset.select(*integers)).collect()}
        return self._copyValues(TablePreparerModel(state=json.dumps(state)))


class TablePreparerModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted values as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state=None):
        super().__init__()
        self._setDefault(numeric=[], categories=[], integers=[], k=1.5, scale=False)
        if state is not None:
            self._set(state=state)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault(self.state))
        out = {c: (_capped(c, state) - F.lit(s["mean"])) / F.lit(s["std"]) if self.getOrDefault(self.scale) else _capped(c, state)
               for c, s in state["numeric"].items()}
        large = {}
        for c, values in state["codes"].items():
            if len(values) > MAP_VALUES:
                large[c] = values
            elif values:
                codes = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
                out[c] = F.coalesce(F.try_element_at(codes, F.col(c).cast("string")), F.lit(-1))
            else:
                out[c] = F.lit(-1)
        out.update({c: F.col(c).cast(t) for c, t in state["types"].items()})
        df = dataset.withColumns(out) if out else dataset
        for c, values in large.items():
            table = df.sparkSession.createDataFrame(list(enumerate(values)), "_code int, _value string")
            df = (df.join(table, F.col(c).cast("string") == F.col("_value"), "left")
                  .withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_code", "_value"))
        return df
