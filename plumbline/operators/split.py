"""Chronological split into development and holdout rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import col, require_columns
from plumbline.operators.ordering import value_at

DEVELOPMENT = "development"
HOLDOUT = "temporal_test"


def temporal_cutoff(df: DataFrame, time: str = "step", test_fraction: float = 0.20) -> object:
    """First time value of the holdout: the last ceil(n * fraction) of n distinct values.

    Distinct values, text among them, are counted by parts of their range, and only the part with the
    cutoff is cut on or sorted, so neither the driver nor one task ever holds all of them.
    """
    if test_fraction <= 0.0 or test_fraction >= 1.0:
        raise ValueError("The holdout takes a share of the times, neither none nor all of them")
    require_columns(df, [time], "Split input")
    steps = df.select(col(time).alias("step")).where(col(time).isNotNull()).distinct()
    n = steps.count()
    if n < 2:
        raise ValueError("A temporal split needs at least two distinct time values")
    n_test = min(max(math.ceil(n * test_fraction), 1), n - 1)
    return value_at(steps, "step", n - n_test)


def split_label(time: str, cutoff: object) -> Column:
    """Name of the side a row falls on; null where the time is null."""
    return F.when(col(time) < F.lit(cutoff), DEVELOPMENT).when(
        col(time) >= F.lit(cutoff), HOLDOUT
    )


def split_temporally(
    df: DataFrame, time: str = "step", test_fraction: float = 0.20
) -> tuple[DataFrame, DataFrame]:
    cutoff = temporal_cutoff(df, time, test_fraction)
    return df.where(col(time) < F.lit(cutoff)), df.where(col(time) >= F.lit(cutoff))


def split_summary(df: DataFrame, time: str, target: str, cutoff: object) -> DataFrame:
    """Rows, time range and positive rows of each side, from one scan."""
    return (
        df.withColumn("split", split_label(time, cutoff))
        .where(F.col("split").isNotNull())
        .groupBy("split")
        .agg(
            F.count("*").alias("rows"),
            F.min(time).alias("min_time"),
            F.max(time).alias("max_time"),
            F.count_if(col(target) == 1).alias("positive_rows"),
        )
    )
