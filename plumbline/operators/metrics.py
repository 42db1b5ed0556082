"""Classification metrics and curves over scored tables, grouped by any keys.

Input columns are the group keys, ``y_true`` (0/1) and ``y_score``. Ranking metrics first
collapse equal scores, then sum up within score buckets, so one large group is no hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import at_least, score_bucket
from plumbline.operators.ordering import match_null_safe, running_totals

# Names of the metrics, in report order.
METRICS = (
    "accuracy", "recall", "specificity", "precision", "f1", "roc_auc", "pr_auc",
    "balanced_accuracy",
)
TIMINGS = ("fit_seconds", "predict_seconds")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion_counts(scored: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    predicted = at_least("y_score", threshold)
    hit = {
        "tn": (F.col("y_true") == 0) & (predicted == 0),
        "fp": (F.col("y_true") == 0) & (predicted == 1),
        "fn": (F.col("y_true") == 1) & (predicted == 0),
        "tp": (F.col("y_true") == 1) & (predicted == 1),
    }
    return scored.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in hit.items()])


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """Add the metrics that follow from tn, fp, fn and tp; an empty denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rates = counts.withColumns(
        {
            "accuracy": _share(tn + tp, tn + fp + fn + tp),
            "recall": _share(tp, tp + fn),
            "specificity": _share(tn, tn + fp),
            "precision": _share(tp, tp + fp),
            "f1": _share(2 * tp, 2 * tp + fp + fn),
        }
    )
    return rates.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def _score_steps(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per distinct score with the counts at it and above it."""
    steps = scored.groupBy(*by, F.col("y_score").cast("double").alias("y_score")).agg(
        F.count_if(F.col("y_true") == 1).alias("tp"),
        F.count_if(F.col("y_true") == 0).alias("fp"),
    )
    return running_totals(
        steps, by, "y_score", ["tp", "fp"], bucket=score_bucket, descending=True
    )


def ranking_metrics(
    scored: DataFrame, by: Sequence[str], single_class: str = "error"
) -> DataFrame:
    """ROC-AUC with ties averaged and step-wise average precision per group.

    A group with one class only fails the query, or gets nulls if ``single_class`` is "null".
    """
    if single_class not in ("error", "null"):
        raise ValueError("single_class must be 'error' or 'null'")
    above = F.col("tp_before") + F.col("tp")
    seen = above + F.col("fp_before") + F.col("fp")
    sums = _score_steps(scored, by).groupBy(*by).agg(
        F.sum("tp").alias("positives"),
        F.sum("fp").alias("negatives"),
        F.sum(F.col("fp") * (F.col("tp_before") + F.col("tp") / 2)).alias("area"),
        F.sum(F.col("tp") * above / seen).alias("gain"),
    )
    p, n = F.col("positives"), F.col("negatives")
    undefined = (
        F.lit(None).cast("double")
        if single_class == "null"
        else F.raise_error(F.lit("Both classes must be present in every group"))
    )

    def defined(value: Column) -> Column:
        return F.when((p > 0) & (n > 0), value).otherwise(undefined)

    return sums.select(
        *by,
        "positives",
        "negatives",
        defined(F.col("area") / p / n).alias("roc_auc"),
        defined(F.col("gain") / p).alias("pr_auc"),
    )


def classification_metrics(
    scored: DataFrame, by: Sequence[str], threshold: float = 0.5, single_class: str = "error"
) -> DataFrame:
    """The eight metrics and the four confusion counts of every group."""
    counts = threshold_metrics(confusion_counts(scored, by, threshold))
    ranks = ranking_metrics(scored, by, single_class).drop("positives", "negatives")
    joined = match_null_safe(counts, ranks, by)
    return joined.select(*by, *METRICS, "tn", "fp", "fn", "tp")


def confusion_matrix(scored: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    return (
        scored.withColumn("y_pred", at_least("y_score", threshold))
        .groupBy(*by, "y_true", "y_pred")
        .agg(F.count("*").alias("rows"))
    )


def _with_totals(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = scored.groupBy(*by).agg(
        F.count_if(F.col("y_true") == 1).alias("positives"),
        F.count_if(F.col("y_true") == 0).alias("negatives"),
    )
    return match_null_safe(_score_steps(scored, by), totals, by)


def pr_curve(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision and recall when every distinct score is the threshold."""
    tp = F.col("tp_before") + F.col("tp")
    fp = F.col("fp_before") + F.col("fp")
    return _with_totals(scored, by).select(
        *by,
        F.col("y_score").alias("threshold"),
        (tp / (tp + fp)).alias("precision"),
        _share(tp, F.col("positives")).alias("recall"),
    )


def roc_curve(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """False and true positive rate when every distinct score is the threshold."""
    return _with_totals(scored, by).select(
        *by,
        F.col("y_score").alias("threshold"),
        _share(F.col("fp_before") + F.col("fp"), F.col("negatives")).alias("fpr"),
        _share(F.col("tp_before") + F.col("tp"), F.col("positives")).alias("tpr"),
    )


def summarize_folds(
    fold_metrics: DataFrame,
    by: Sequence[str] = ("model",),
    metrics: Sequence[str] = (*METRICS, *TIMINGS),
) -> DataFrame:
    """Mean and sample standard deviation over folds."""
    return fold_metrics.groupBy(*by).agg(
        *[
            x
            for m in metrics
            for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))
        ]
    )


def summarize_successful(
    fold_metrics: DataFrame, by: Sequence[str] = ("model",), metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Long ``(*by, metric, mean, std, minimum, maximum)`` over successful folds.

    The spread of a single fold is 0.
    """
    ok = fold_metrics.where(F.col("status") == "success") if "status" in fold_metrics.columns else fold_metrics
    entries = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ]
    return (
        ok.select(*by, F.inline(F.array(*entries)))
        .groupBy(*by, "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
        )
    )


def run_status(fold_results: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Status, fold counts and total seconds of each run from its fold rows."""
    good = F.count_if(F.col("status") == "success")
    bad = F.count_if(F.col("status") != "success")
    return fold_results.groupBy(*by).agg(
        F.when(good == 0, "error").when(bad > 0, "partial_failure").otherwise("success").alias(
            "status"
        ),
        good.alias("successful_folds"),
        bad.alias("failed_folds"),
        F.sum("fit_seconds").alias("total_fit_seconds"),
        F.sum("predict_seconds").alias("total_predict_seconds"),
    )


def baseline_outcomes(fold_metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean metrics and summed seconds per model, shaped like candidate outcomes."""
    return fold_metrics.groupBy(*by).agg(
        F.lit("success").alias("status"),
        F.avg("pr_auc").alias("primary_metric"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        F.sum("fit_seconds").alias("fit_seconds"),
        F.sum("predict_seconds").alias("predict_seconds"),
    )
