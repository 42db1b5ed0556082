"""Paired comparison of two pipelines on identical folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.durability import durable
from plumbline.functions.expressions import magnitude_bucket, require_columns
from plumbline.operators.ordering import exact_quantiles, match_null_safe, running_totals

KEYS = ("model", "repeat", "fold")
# Compared metrics, tie tolerance, significance level, largest exact sample.
COMPARED = ("pr_auc", "recall", "precision", "f1")
TIE_TOLERANCE = 1e-8
ALPHA = 0.05
EXACT_PAIRS = 50


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def unpaired_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys that one side lacks, with the side that has them."""
    a = left.select(*keys, F.lit(True).alias("in_left"))
    b = right.select(*keys, F.lit(True).alias("in_right"))
    return (
        a.join(b, list(keys), "full_outer")
        .where(F.col("in_left").isNull() | F.col("in_right").isNull())
        .select(*keys, F.when(F.col("in_left"), "left").otherwise("right").alias("present_in"))
    )


def check_pairs(
    left: DataFrame,
    right: DataFrame,
    metrics: Sequence[str] = COMPARED,
    keys: Sequence[str] = KEYS,
) -> None:
    for side, df in (("left", left), ("right", right)):
        require_columns(df, [*keys, *metrics], f"The {side} result table")
        if not duplicate_keys(df, keys).isEmpty():
            raise ValueError(f"The {side} result table repeats keys")
    if not unpaired_keys(left, right, keys).isEmpty():
        raise ValueError("The result tables do not hold the same keys")


def paired_values(
    left: DataFrame,
    right: DataFrame,
    metrics: Sequence[str] = COMPARED,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Long ``(*keys, metric, reference, candidate, delta)`` of the matching rows."""
    a = left.select(*keys, *[F.col(m).cast("double").alias(f"l_{m}") for m in metrics])
    b = right.select(*keys, *[F.col(m).cast("double").alias(f"r_{m}") for m in metrics])
    entries = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"l_{m}").alias("reference"),
            F.col(f"r_{m}").alias("candidate"),
            (F.col(f"r_{m}") - F.col(f"l_{m}")).alias("delta"),
        )
        for m in metrics
    ]
    return a.join(b, list(keys)).select(*keys, F.inline(F.array(*entries)))


def paired_deltas(pairs: DataFrame, by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Pairs, means, mean and median difference, wins and ties of every group."""
    means = pairs.groupBy(*by).agg(
        F.count("*").alias("pairs"),
        F.avg("reference").alias("reference_mean"),
        F.avg("candidate").alias("candidate_mean"),
        F.avg("delta").alias("mean_delta"),
        F.stddev_samp("delta").alias("std_delta"),
        F.count_if(F.col("delta") > 0).alias("wins"),
        F.count_if(F.abs("delta") <= TIE_TOLERANCE).alias("ties"),
    )
    middle = exact_quantiles(pairs, ["delta"], [0.5], by).select(
        *by, F.col("quantile").alias("median_delta")
    )
    return match_null_safe(means, middle, by, "left")


def signed_ranks(pairs: DataFrame, by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Signed-rank sums of every group, ties sharing their mean rank.

    ``(*by, nonzero_pairs, zero_pairs, w_plus, w_minus, tie_term, statistic)``. Equal sizes
    collapse to one row first and running totals replace a sort of the whole group. If every
    difference is within the tie tolerance the statistic is 0.
    """
    sizes = (
        pairs.withColumn("size", F.abs("delta"))
        .groupBy(*by, "size")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("delta") > 0).alias("up"),
            F.count_if(F.col("delta") < 0).alias("down"),
        )
    )
    zeros = sizes.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("size") == 0, F.col("n"))), F.lit(0)).alias("zero_pairs"),
        F.max("size").alias("largest"),
    )
    ranked = running_totals(
        sizes.where(F.col("size") > 0), by, "size", ["n"], bucket=magnitude_bucket
    )
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("nonzero_pairs"),
        F.sum(F.col("up") * rank).alias("w_plus"),
        F.sum(F.col("down") * rank).alias("w_minus"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("tie_term"),
    )
    joined = match_null_safe(zeros, sums, by, "left").withColumns(
        {
            "nonzero_pairs": F.coalesce("nonzero_pairs", F.lit(0)),
            **{c: F.coalesce(c, F.lit(0.0)) for c in ("w_plus", "w_minus", "tie_term")},
        }
    )
    flat = F.coalesce(F.col("largest") <= TIE_TOLERANCE, F.lit(True))
    return joined.withColumn(
        "statistic", F.when(flat, 0.0).otherwise(F.least("w_plus", "w_minus"))
    ).select(
        *by, "nonzero_pairs", "zero_pairs", "w_plus", "w_minus", "tie_term", "statistic",
        flat.alias("all_zero"),
    )


def _exact_p(n: int, statistic: float) -> float:
    """Two-sided p from the number of rank subsets that reach each sum."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] += ways[:-rank].copy()
    return min(1.0, 2.0 * ways[: int(statistic) + 1].sum() / 2.0**n)


@F.pandas_udf(T.DoubleType())
def _wilcoxon_p(
    n: pd.Series, zeros: pd.Series, ties: pd.Series, statistic: pd.Series, flat: pd.Series
) -> pd.Series:
    def one(n: int, zeros: int, ties: float, w: float, flat: bool) -> float:
        if flat:
            return 1.0
        if not zeros and not ties and n <= EXACT_PAIRS:
            return _exact_p(int(n), w)
        variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
        z = (w - n * (n + 1) / 4) / math.sqrt(variance)
        return math.erfc(abs(z) / math.sqrt(2))

    return pd.Series([one(*row) for row in zip(n, zeros, ties, statistic, flat)], dtype="float64")


def wilcoxon(pairs: DataFrame, by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Two-sided Wilcoxon signed-rank test per group; adds ``p_value``.

    Exact without zero or tied differences up to 50 pairs, else the tie-corrected normal
    approximation. Python sees one row per group.
    """
    ranks = signed_ranks(pairs, by)
    return ranks.withColumn(
        "p_value",
        _wilcoxon_p("nonzero_pairs", "zero_pairs", "tie_term", "statistic", "all_zero"),
    ).drop("all_zero")


def holm_adjust(tests: DataFrame, p: str = "p_value", family: Sequence[str] = ()) -> DataFrame:
    """Add Holm-Bonferroni adjusted p-values over all rows of a family.

    Equal p-values collapse first: of several with one value the first ranked decides.
    """
    adjusted, flag = f"{p}_holm", "significant"
    steps = tests.groupBy(*family, F.col(p)).agg(F.count("*").alias("n"))
    sizes = steps.groupBy(*family).agg(F.sum("n").alias("m"))
    placed = running_totals(steps, family, p, ["n"], bucket=magnitude_bucket)
    raw = match_null_safe(placed, sizes, family) if family else placed.withColumn(
        "m", sizes.select("m").scalar()
    )
    raw = raw.withColumn(
        "raw", F.least(F.lit(1.0), (F.col("m") - F.col("n_before")) * F.col(p))
    ).withColumn("_bucket", magnitude_bucket(F.col(p)))
    tops = raw.groupBy(*family, "_bucket").agg(F.max("raw").alias("top"))
    earlier = W.partitionBy(*family).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = tops.select(*family, "_bucket", F.max("top").over(earlier).alias("floor"))
    inside = W.partitionBy(*family, "_bucket").orderBy(p).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    done = match_null_safe(raw, offsets, [*family, "_bucket"]).select(
        *family, p, F.greatest(F.max("raw").over(inside), F.col("floor")).alias(adjusted)
    )
    return match_null_safe(tests, done, [*family, p], "left").withColumn(
        flag, F.col(adjusted) < ALPHA
    )


def compare_pipelines(
    reference: DataFrame,
    candidate: DataFrame,
    metrics: Sequence[str] = COMPARED,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Differences, Wilcoxon test and Holm correction for every model and metric.

    The matched pairs and the tests are each read several times, so both are checkpointed.
    """
    check_pairs(reference, candidate, metrics, keys)
    pairs = durable(paired_values(reference, candidate, metrics, keys))
    by = ["model", "metric"]
    tests = match_null_safe(paired_deltas(pairs, by), wilcoxon(pairs, by), by)
    return holm_adjust(durable(tests))


def t_quantile(freedom: Column) -> Column:
    """97.5 % point of Student's t: exact for one and two degrees of freedom, else a series.

    The series around the normal point errs by 0.4 % at three degrees and less than 1e-6 from 24.
    """
    z, v = 1.959963984540054, freedom.cast("double")
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    series = F.lit(z)
    for power, term in enumerate(terms, 1):
        series = series + F.lit(term) / F.pow(v, F.lit(power))
    return (
        F.when(v == 1, 12.706204736174698).when(v == 2, 4.302652729749464).when(v > 2, series)
    )


def effect_sizes(pairs: DataFrame, by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Student's 95 % interval of the mean difference and the rank-biserial correlation.

    A single pair has no interval.
    """
    deltas = paired_deltas(pairs, by)
    half = t_quantile(F.col("pairs") - 1) * F.col("std_delta") / F.sqrt("pairs")
    ranks = signed_ranks(pairs, by)
    whole = F.col("w_plus") + F.col("w_minus")
    return match_null_safe(deltas, ranks, by).select(
        *by,
        "pairs",
        "mean_delta",
        (F.col("mean_delta") - half).alias("low"),
        (F.col("mean_delta") + half).alias("high"),
        F.when(whole > 0, (F.col("w_plus") - F.col("w_minus")) / whole)
        .otherwise(0.0)
        .alias("rank_biserial"),
    )
