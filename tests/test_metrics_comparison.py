import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import comparison as cp
from plumbline.operators import metrics as mt
from plumbline.operators import report as rp


def scored(spark, y, s, group="g"):
    return spark.createDataFrame(
        [(group, int(a), float(b)) for a, b in zip(y, s)], "g string, y_true int, y_score double"
    )


def test_four_way_confusion(spark):
    row = mt.classification_metrics(scored(spark, [0, 0, 1, 1], [.1, .8, .9, .2]), ["g"]).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 1, 1, 1)
    for m in ("accuracy", "recall", "specificity", "precision", "f1", "balanced_accuracy"):
        assert row[m] == 0.5


def test_ranking_with_ties(spark):
    row = mt.ranking_metrics(scored(spark, [0, 0, 1, 1, 1], [.1, .8, .9, .2, .8]), ["g"]).first()
    assert row["roc_auc"] == pytest.approx(0.75)
    assert row["pr_auc"] == pytest.approx(0.805556, abs=1e-6)


def test_ranking_equals_pair_counting(spark):
    """Scores below 0, at the ends and far beyond 1, in two groups, one of them constant."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.concatenate([rng.random(100), 1 - 10.0 ** -rng.integers(1, 17, 100), rng.normal(0, 50, 100).round()])
    s[:5] = [0.0, 1.0, 0.0, 1.0, -0.0]
    df = scored(spark, y, s).unionByName(scored(spark, [0, 1], [0.5, 0.5], "h"))
    got = {r["g"]: r for r in mt.ranking_metrics(df.repartition(7), ["g"]).collect()}
    p, n = s[y == 1], s[y == 0]
    auc = ((p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()) / len(p) / len(n)
    assert got["g"]["roc_auc"] == pytest.approx(auc)
    levels = sorted(set(s), reverse=True)
    ap, before = 0.0, 0
    for t in levels:
        tp, seen = ((s >= t) & (y == 1)).sum(), (s >= t).sum()
        ap += (tp - before) / len(p) * tp / seen
        before = tp
    assert got["g"]["pr_auc"] == pytest.approx(ap)
    assert got["h"]["roc_auc"] == 0.5 and got["h"]["pr_auc"] == 0.5


def test_guards(spark):
    with pytest.raises(Exception, match="Both classes"):
        mt.ranking_metrics(scored(spark, [1, 1], [.1, .2]), ["g"]).collect()
    with pytest.raises(ValueError, match="threshold"):
        mt.confusion_counts(scored(spark, [0, 1], [.1, .2]), ["g"], 1.1)


def test_empty_denominators_are_zero(spark):
    row = mt.threshold_metrics(mt.confusion_counts(scored(spark, [0, 1], [.1, .2]), ["g"])).first()
    assert (row["recall"], row["precision"], row["f1"]) == (0, 0, 0)


def test_curves(spark):
    df = scored(spark, [0, 0, 1, 1], [.1, .8, .9, .2])
    pr = [(r["threshold"], r["precision"], r["recall"]) for r in mt.pr_curve(df, ["g"]).orderBy("threshold").collect()]
    assert pr == [(.1, .5, 1), (.2, pytest.approx(2 / 3), 1), (.8, .5, .5), (.9, 1, .5)]
    roc = [(r["fpr"], r["tpr"]) for r in mt.roc_curve(df, ["g"]).orderBy("threshold").collect()]
    assert roc == [(1, 1), (.5, 1), (.5, .5), (0, .5)]


def test_summaries(spark):
    df = spark.createDataFrame(
        [("m", "success", .5, 1.0, 2.0), ("m", "success", .7, 1.0, 2.0), ("m", "error", None, 1.0, 0.0),
         ("n", "success", .4, 1.0, 1.0), ("z", "error", None, 1.0, 1.0)],
        "model string, status string, pr_auc double, fit_seconds double, predict_seconds double",
    )
    s = {r["model"]: r for r in mt.summarize_successful(df, metrics=["pr_auc"]).collect()}
    assert s["m"]["mean"] == pytest.approx(.6) and s["m"]["std"] == pytest.approx(math.sqrt(.02))
    assert s["n"]["std"] == 0 and "z" not in s
    st = {r["model"]: r for r in mt.run_status(df).collect()}
    assert {k: v["status"] for k, v in st.items()} == {"m": "partial_failure", "n": "success", "z": "error"}
    assert st["m"]["failed_folds"] == 1 and st["m"]["total_fit_seconds"] == 3


def folds(spark, shift=0.0, n=5, model="m"):
    return spark.createDataFrame(
        [(model, 1, i, .5 + .01 * i + shift * (1 + .1 * i), .4, .3, .2) for i in range(1, n + 1)],
        "model string, repeat int, fold int, pr_auc double, recall double, precision double, f1 double",
    )


def test_constant_gain(spark):
    base = folds(spark)
    better = base.withColumn("pr_auc", F.col("pr_auc") + .02)
    rows = {r["metric"]: r for r in cp.compare_pipelines(base, better).collect()}
    assert rows["pr_auc"]["pairs"] == 5 and rows["pr_auc"]["wins"] == 5
    assert rows["pr_auc"]["mean_delta"] == pytest.approx(.02)
    assert rows["recall"]["statistic"] == 0 and rows["recall"]["p_value"] == 1.0
    assert rows["recall"]["ties"] == 5
    assert all(r["p_value_holm"] >= r["p_value"] for r in rows.values())


def test_unpaired_results_are_refused(spark):
    with pytest.raises(ValueError, match="same keys"):
        cp.compare_pipelines(folds(spark), folds(spark, n=4))
    with pytest.raises(ValueError, match="repeats"):
        cp.compare_pipelines(folds(spark).union(folds(spark)), folds(spark))
    with pytest.raises(ValueError, match="missing"):
        cp.compare_pipelines(folds(spark).drop("f1"), folds(spark))


def pairs(spark, deltas):
    return spark.createDataFrame(
        [("m", "x", 0.0, float(d), float(d)) for d in deltas],
        "model string, metric string, reference double, candidate double, delta double",
    )


@pytest.mark.parametrize("negative, p", [
    (set(), 5.960464477539063e-08),
    ({25, 24, 23, 22, 21, 9}, 0.312333345413208),
])
def test_exact_wilcoxon(spark, negative, p):
    row = cp.wilcoxon(pairs(spark, [-i if i in negative else i for i in range(1, 26)])).first()
    assert row["statistic"] == sum(negative)
    assert row["p_value"] == pytest.approx(p, rel=1e-9)


def test_normal_wilcoxon_with_zeros_and_ties(spark):
    row = cp.wilcoxon(pairs(spark, [0, 0, -1, -1, 2, 2, 2, 3, 4, 5])).first()
    assert (row["nonzero_pairs"], row["zero_pairs"], row["statistic"]) == (8, 2, 3.0)
    z = (3 - 18) / math.sqrt(8 * 9 * 17 / 24 - (6 + 24) / 48)
    assert row["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_all_within_tolerance_is_no_difference(spark):
    row = cp.wilcoxon(pairs(spark, [1e-9, -2e-9, 0.0])).first()
    assert (row["statistic"], row["p_value"]) == (0.0, 1.0)


# Raw and adjusted p-values of twelve published tests.
RAW = [5.960464477539063e-08, 3.992397476901338e-05, 0.312333345413208, 0.055070459842681885,
       0.0626264214515686, 0.5051398461335725, 0.10139739513397217, 0.09031611680984497,
       0.39571136236190796, 0.5624851814825781, 0.00012022256851196289, 0.00016230344772338867]
HOLM = [7.152557373046875e-07, 0.0004391636224591472, 1.0, 0.4405636787414551, 0.4405636787414551,
        1.0, 0.5418967008590698, 0.5418967008590698, 1.0, 1.0, 0.001202225685119629,
        0.001460731029510498]


def test_holm(spark):
    df = spark.createDataFrame(list(enumerate(RAW)), "i int, p_value double")
    out = cp.holm_adjust(df).orderBy("i").collect()
    assert [r["p_value_holm"] for r in out] == pytest.approx(HOLM)
    assert [r["significant"] for r in out] == [h < .05 for h in HOLM]


def test_holm_with_equal_values_and_families(spark):
    df = spark.createDataFrame(
        [("a", .01), ("a", .01), ("a", .9), ("b", 0.0), ("b", .04)], "f string, p_value double"
    )
    out = sorted((r["f"], r["p_value_holm"]) for r in cp.holm_adjust(df, family=["f"]).collect())
    assert out == [("a", .03), ("a", .03), ("a", .9), ("b", 0.0), ("b", .04)]


def test_effect_sizes(spark):
    row = cp.effect_sizes(pairs(spark, [1, 2, 3, -4])).first()
    assert row["rank_biserial"] == pytest.approx(.2)
    assert row["low"] < row["mean_delta"] < row["high"]


def test_report(spark):
    models, pipelines = ["a", "b"], ["fixed", "plan"]
    df = spark.createDataFrame(
        [(p, m, i / 10) for i, (m, p) in enumerate((m, p) for m in models for p in pipelines)],
        "pipeline string, model string, pr_auc double",
    )
    out = {r["model"]: r for r in rp.metric_pivot(df, "pr_auc", ("fixed", "plan")).collect()}
    assert out["b"]["delta"] == pytest.approx(.1)
    assert rp.incomplete_pairs(df, models, pipelines).isEmpty()
    broken = df.where("model = 'a'").union(df.where("model = 'a' and pipeline = 'plan'"))
    found = {tuple(r) for r in rp.incomplete_pairs(broken, models, pipelines).collect()}
    assert found == {("a", "plan", 2), ("b", "fixed", 0), ("b", "plan", 0)}
