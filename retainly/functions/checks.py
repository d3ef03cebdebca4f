"""Uniform check rows: every validator emits (check, subject, actual, expected, status).

Checks are built from aggregate DataFrames, never from collected values, so a
validator is one lazy plan that the caller can union with others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSED, FAILED, WARNING, SKIPPED, UNKNOWN = "PASSED", "FAILED", "WARNING", "SKIPPED", "UNKNOWN"
CHECK_COLUMNS = ["check", "subject", "actual", "expected", "status"]


def check_row(df: DataFrame, name: str, subject: str | Column, actual: Column, expected: str,
              passed: Column, fail_status: str = FAILED) -> DataFrame:
    """One check per row of ``df`` (usually a 1-row aggregate).

    A null ``passed`` (missing metric, empty input) becomes UNKNOWN, never PASSED.
    """
    subj = F.lit(subject) if isinstance(subject, str) else subject
    status = (F.when(passed.isNull(), F.lit(UNKNOWN))
              .when(passed, F.lit(PASSED)).otherwise(F.lit(fail_status)))
    return df.select(F.lit(name).alias("check"), subj.cast("string").alias("subject"),
                     actual.cast("double").alias("actual"), F.lit(expected).alias("expected"),
                     status.alias("status"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def check_rows(df: DataFrame, specs: list[tuple]) -> DataFrame:
    """Several checks over the SAME aggregate row(s), emitted by one ``inline`` (one scan, no union).

    ``specs``: (name, subject, actual Column, expected str, passed Column[, fail_status]).
    """
    structs = []
    for spec in specs:
        name, subject, actual, expected, passed = spec[:5]
        fail = spec[5] if len(spec) > 5 else FAILED
        subj = F.lit(subject) if isinstance(subject, str) else subject
        status = F.when(passed.isNull(), F.lit(UNKNOWN)).when(passed, F.lit(PASSED)).otherwise(F.lit(fail))
        structs.append(F.struct(F.lit(name).alias("check"), subj.cast("string").alias("subject"),
                                actual.cast("double").alias("actual"), F.lit(expected).alias("expected"),
                                status.alias("status")))
    return df.select(F.inline(F.array(*structs)))
