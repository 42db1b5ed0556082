"""Four quality dimensions and their weighted score."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import nan_to_null
from plumbline.functions.rules import Rule
from plumbline.operators.profile import table_profile

# Weights of the composite score.
WEIGHTS = {"completeness": 0.30, "validity": 0.25, "consistency": 0.25, "uniqueness": 0.20}


def bounded_score(failures: str | Column, chances: Column) -> Column:
    """1 - failures / chances; impossible counts fail the query."""
    failed = F.col(failures) if isinstance(failures, str) else failures
    return (
        F.when((failed < 0) | (chances < 0), F.raise_error(F.lit("Quality counts are negative")))
        .when(failed > chances, F.raise_error(F.lit("More quality failures than chances")))
        .when(chances == 0, F.lit(1.0))
        .otherwise(1.0 - failed / chances)
        .cast("double")
    )


def check_weights(weights: Mapping[str, float]) -> None:
    if set(weights) != set(WEIGHTS):
        raise ValueError(f"Quality weights must be given for: {', '.join(WEIGHTS)}")
    if any(w < 0 for w in weights.values()):
        raise ValueError("Quality weights cannot be negative")
    if not math.isclose(sum(weights.values()), 1.0, rel_tol=0.0, abs_tol=1e-9):
        raise ValueError("Quality weights must sum to 1")


def quality_score(profile: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Add the dimensions and the score to rows shaped like ``table_profile``.

    An expression over counts: the profiled table is not read again.
    """
    check_weights(weights)
    rows = F.col("rows")
    scored = profile.withColumns(
        {
            "total_cells": rows * F.col("columns"),
            "completeness": bounded_score("missing_cells", rows * F.col("columns")),
            "validity": bounded_score("validity_failures", rows * F.col("validity_checks")),
            "consistency": bounded_score(
                "consistency_failures", rows * F.col("consistency_checks")
            ),
            "uniqueness": bounded_score("duplicate_rows", rows),
        }
    )
    parts = [F.lit(weights[d]) * F.col(d) for d in WEIGHTS]
    return scored.withColumn("data_quality_score", sum(parts[1:], parts[0]))


def quality_of(
    df: DataFrame, rules: Sequence[Rule] = (), weights: Mapping[str, float] = WEIGHTS
) -> DataFrame:
    """Quality of a table. NaN counts as missing."""
    return quality_score(table_profile(nan_to_null(df), rules), weights)


def score_report(report: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Quality of rows shaped like ``profile_report``, as read back from a saved report.

    Missing cells are the sum of the columns' null counts; no profiled table is needed.
    """
    missing = F.aggregate(
        F.transform("columns", lambda c: c["null_count"].cast("long")),
        F.lit(0).cast("long"),
        lambda a, n: a + n,
    )
    counts = report.select(
        F.col("dimensions.rows").alias("rows"),
        F.col("dimensions.columns").alias("columns"),
        missing.alias("missing_cells"),
        F.col("duplicates.duplicate_rows").alias("duplicate_rows"),
        *[F.col(f"{k}.{k}_{what}") for k in ("validity", "consistency") for what in ("checks", "failures")],
    )
    return quality_score(counts, weights)
