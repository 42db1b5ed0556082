"""Side-by-side report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_pivot(
    metrics: DataFrame,
    metric: str,
    pipelines: tuple[str, str],
    by: Sequence[str] = ("model",),
) -> DataFrame:
    """``(*by, <first>, <second>, delta)`` of one metric for two pipelines."""
    first, second = pipelines
    return (
        metrics.groupBy(*by)
        .pivot("pipeline", list(pipelines))
        .agg(F.first(metric))
        .withColumn("delta", F.col(second) - F.col(first))
    )


def incomplete_pairs(
    metrics: DataFrame, models: Sequence[str], pipelines: Sequence[str]
) -> DataFrame:
    """``(model, pipeline, rows)`` wherever there is not exactly one expected row."""
    wanted = metrics.sparkSession.createDataFrame(
        [(m, p) for m in models for p in pipelines], "model string, pipeline string"
    ).withColumn("wanted", F.lit(1))
    found = metrics.groupBy("model", "pipeline").agg(F.count("*").alias("rows"))
    return (
        wanted.join(found, ["model", "pipeline"], "full_outer")
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
        .where((F.col("rows") != 1) | F.col("wanted").isNull())
        .select("model", "pipeline", "rows")
    )


def quality_runtime_table(before: DataFrame, after: DataFrame, runtime_multiplier: float | None) -> DataFrame:
    """One row with the quality before and after a plan and its relative runtime."""
    first = before.select("data_quality_score").scalar()
    return after.select(
        first.alias("initial_data_quality_score"),
        F.col("data_quality_score").alias("selected_data_quality_score"),
        (F.col("data_quality_score") - first).alias("selected_quality_delta"),
        F.lit(runtime_multiplier).cast("double").alias("selected_runtime_multiplier"),
    )
