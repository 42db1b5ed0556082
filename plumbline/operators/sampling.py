"""Exact, seeded samples and class balance.

Membership depends on the row's key and the seed only. Samples are plain filters on the draw,
so they cost scans and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import col, draw, draw_number, require_columns
from plumbline.operators.ordering import draw_cuts, match_null_safe, rank_by_draw


def two_class_counts(df: DataFrame, target: str) -> dict[object, int]:
    """Rows of the smallest and the largest value, null left out; others are an error.

    Two aggregates of one row each, whatever the number of values.
    """
    y = col(target)
    ends = df.agg(F.min(y).alias("low"), F.max(y).alias("high")).first()
    low, high = ends["low"], ends["high"]
    if low is None or low == high:
        raise ValueError("Class balance needs exactly two classes")
    n = df.agg(
        F.count(y).alias("all"), F.count_if(y == F.lit(low)).alias("low"),
        F.count_if(y == F.lit(high)).alias("high"),
    ).first()
    if n["low"] + n["high"] != n["all"]:
        raise ValueError("Class balance needs exactly two classes")
    return {low: n["low"], high: n["high"]}


def _two_classes(df: DataFrame, target: str) -> tuple[object, int, object, int]:
    """The smaller class and the larger one; the smaller value counts as minority on a tie."""
    counts = two_class_counts(df, target)
    (minor, m), (major, n) = sorted(counts.items(), key=lambda p: (p[1], p[0]))
    return minor, m, major, n


def exact_sample(
    df: DataFrame, key: Sequence[str], n: int, seed: int, where: Column | None = None
) -> DataFrame:
    """Exactly ``n`` rows, optionally only of those that satisfy ``where``."""
    require_columns(df, key, "Sample input")
    rows = df if where is None else df.where(where)
    drawn = draw(seed, *key)
    cuts = draw_cuts(rows, {"sample": drawn}, {"sample": n})
    return rows.where(drawn <= F.lit(cuts["sample"])) if n > 0 else rows.limit(0)


def case_control_sample(
    df: DataFrame, target: str, key: Sequence[str], ratio: int = 10, seed: int = 42
) -> DataFrame:
    """Every positive row and exactly ``ratio`` negatives for each, as one filter."""
    if ratio < 1:
        raise ValueError("The negative to positive ratio must be at least 1")
    require_columns(df, [target, *key], "Sample input")
    counts = df.agg(
        F.count_if(col(target) == 1).alias("positives"),
        F.count_if(col(target) == 0).alias("negatives"),
    ).first()
    positives, negatives = counts["positives"], counts["negatives"]
    if not positives:
        raise ValueError("The table has no positive rows")
    if positives * ratio > negatives:
        raise ValueError("More negative rows requested than available")
    drawn = draw(seed, *key)
    contest = F.when(col(target) == 0, drawn)
    cut = draw_cuts(df, {"negative": contest}, {"negative": positives * ratio})["negative"]
    return df.where((col(target) == 1) | ((col(target) == 0) & (drawn <= F.lit(cut))))


def shuffled(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """Rows in a reproducible random order."""
    return df.orderBy(draw(seed, *key), *key)


def undersample(df: DataFrame, target: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """The minority class whole and as many rows of the other class."""
    minor, m, major, _ = _two_classes(df, target)
    drawn = draw(seed, *key)
    contest = F.when(col(target) == F.lit(major), drawn)
    cut = draw_cuts(df, {"major": contest}, {"major": m})["major"]
    return df.where(
        (col(target) == F.lit(minor)) | ((col(target) == F.lit(major)) & (drawn <= F.lit(cut)))
    )


def oversample(df: DataFrame, target: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Both classes whole plus minority rows drawn with replacement up to the larger class.

    The i-th extra row is the one at rank ``draw(seed, i) mod m``. Extra draws spread over the
    minority evenly; a small minority is broadcast by its size, so no key runs hot.
    """
    minor, m, _, n = _two_classes(df, target)
    if m == n:
        return df.where(col(target).isNotNull())
    ranked = rank_by_draw(
        df.where(col(target) == F.lit(minor)).withColumn("_draw", draw(seed, *key)),
        [],
        "_draw",
        key,
        "_rank",
    ).withColumn("_rank", F.col("_rank") - 1)
    picks = df.sparkSession.range(n - m).select(
        (draw_number(draw(seed, F.lit("extra"), F.col("id"))) % F.lit(m)).alias("_rank")
    )
    extra = picks.join(ranked, "_rank").select(*df.columns)
    return df.where(col(target).isNotNull()).unionByName(extra)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """``(class, rows, weight)`` with balanced weights n / (k * n_c)."""
    counts = (
        df.where(col(target).isNotNull())
        .groupBy(col(target).alias("class"))
        .agg(F.count("*").alias("rows"))
    )
    totals = counts.agg(F.sum("rows") / F.count("*")).scalar()
    return counts.withColumn("weight", totals / F.col("rows"))


def add_class_weights(
    df: DataFrame, target: str, train: DataFrame | None = None, weight: str = "weight"
) -> DataFrame:
    """Add the weight of the row's class, learned on the training rows."""
    weights = class_weights(df if train is None else train, target).select(
        F.col("class").alias(target), F.col("weight").alias(weight)
    )
    return match_null_safe(df, F.broadcast(weights), [target], "left")
