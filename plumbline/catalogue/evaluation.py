"""Queries on metrics, paired comparison, report tables and model training."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalogue.common import (
    SCORED,
    TX,
    query,
    rounded,
    scored_documents,
    scratch,
    table,
    transactions,
    with_sql,
)
from plumbline.operators import comparison as cp
from plumbline.operators import metrics as mt
from plumbline.operators import report as rp
from plumbline.operators.features import prepare_features
from plumbline.operators.sampling import case_control_sample
from plumbline.operators.split import split_temporally
from plumbline.plans.application import Action, Plan
from plumbline.sources import tables as src
from plumbline.training.benchmark import (
    MODEL_FEATURES,
    benchmark,
    candidate_evidence,
    compare_on_holdout,
    fixed_plan,
)

CONFUSION = SCORED + """,
confusion AS (
  SELECT lang, count(*) FILTER (y_true = 0 AND y_score < 0.5) AS tn,
         count(*) FILTER (y_true = 0 AND y_score >= 0.5) AS fp,
         count(*) FILTER (y_true = 1 AND y_score < 0.5) AS fn,
         count(*) FILTER (y_true = 1 AND y_score >= 0.5) AS tp
  FROM scored GROUP BY lang),
rates AS (
  SELECT *, (tn + tp) / (tn + fp + fn + tp)::DOUBLE AS accuracy,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
         CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS specificity,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1
  FROM confusion)"""

RANKING = """
steps AS (
  SELECT lang, y_score, count(*) FILTER (y_true = 1) AS tp, count(*) FILTER (y_true = 0) AS fp
  FROM scored GROUP BY 1, 2),
reached AS (
  SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp,
         sum(tp) OVER (PARTITION BY lang) AS p, sum(fp) OVER (PARTITION BY lang) AS n
  FROM steps WINDOW w AS (PARTITION BY lang ORDER BY y_score DESC)),
auc AS (
  SELECT a.lang, sum(CASE WHEN a.y_score > b.y_score THEN 1.0 WHEN a.y_score = b.y_score THEN 0.5
                          ELSE 0 END) / count(*) AS roc_auc
  FROM scored a JOIN scored b ON a.lang = b.lang AND a.y_true = 1 AND b.y_true = 0
  GROUP BY 1),
ap AS (SELECT lang, CASE WHEN max(p) > 0 AND max(n) > 0
                THEN sum(tp * ctp / (ctp + cfp)::DOUBLE) / max(p) END AS pr_auc
       FROM reached GROUP BY 1)"""

RATES_LIST = """round(accuracy, 6) AS accuracy, round(recall, 6) AS recall,
  round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(f1, 6) AS f1,
  round((recall + specificity) / 2, 6) AS balanced_accuracy"""


@query("confusion_counts", with_sql(CONFUSION) + "SELECT * FROM confusion")
def confusion_counts(spark, folder):
    return mt.confusion_counts(scored_documents(spark, folder), ["lang"])


@query(
    "confusion_metrics",
    with_sql(CONFUSION) + f"SELECT lang, tn, fp, fn, tp, {RATES_LIST} FROM rates",
)
def confusion_metrics(spark, folder):
    counts = mt.confusion_counts(scored_documents(spark, folder), ["lang"])
    return rounded(mt.threshold_metrics(counts))


@query(
    "confusion_matrix",
    with_sql(SCORED) + """
    SELECT lang, y_true::BIGINT AS y_true, CAST(y_score >= 0.5 AS BIGINT) AS y_pred,
           count(*) AS rows FROM scored GROUP BY 1, 2, 3""",
)
def confusion_matrix(spark, folder):
    return rounded(mt.confusion_matrix(scored_documents(spark, folder), ["lang"]))


@query(
    "ranking_metrics",
    with_sql(SCORED, RANKING) + """
    SELECT ap.lang, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc
    FROM ap LEFT JOIN auc ON auc.lang = ap.lang""",
)
def ranking_metrics(spark, folder):
    out = mt.ranking_metrics(scored_documents(spark, folder), ["lang"], "null")
    return rounded(out.select("lang", "roc_auc", "pr_auc"))


@query(
    "ranking_metrics_lineitem",
    """WITH s AS (SELECT (l_returnflag = 'R')::INT AS y, l_extendedprice AS s FROM lineitem),
       g AS (SELECT s, sum(y) AS tp, sum(1 - y) AS fp FROM s GROUP BY s),
       c AS (SELECT *, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(fp) OVER (ORDER BY s DESC) AS cfp
             FROM g)
       SELECT round(sum(fp * (ctp - tp / 2.0)) / (sum(tp) * sum(fp)), 6) AS roc_auc,
              round(sum(tp * ctp / (ctp + cfp)::DOUBLE) / sum(tp), 6) AS pr_auc FROM c""",
)
def ranking_metrics_lineitem(spark, folder):
    scored = table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        F.col("l_extendedprice").alias("y_score"),
    )
    return rounded(mt.ranking_metrics(scored, []).select("roc_auc", "pr_auc"))


@query(
    "classification_metrics",
    with_sql(CONFUSION, RANKING) + f"""
    SELECT rates.lang, tn, fp, fn, tp, {RATES_LIST}, round(roc_auc, 6) AS roc_auc,
           round(pr_auc, 6) AS pr_auc
    FROM rates LEFT JOIN auc ON rates.lang = auc.lang JOIN ap ON rates.lang = ap.lang""",
)
def classification_metrics(spark, folder):
    scored = scored_documents(spark, folder)
    return rounded(mt.classification_metrics(scored, ["lang"], single_class="null"))


@query(
    "pr_curve",
    with_sql(SCORED, RANKING) + """
    SELECT lang, y_score AS threshold, round(ctp / (ctp + cfp)::DOUBLE, 6) AS precision,
           round(coalesce(ctp / nullif(p, 0)::DOUBLE, 0), 6) AS recall FROM reached""",
)
def pr_curve(spark, folder):
    return rounded(mt.pr_curve(scored_documents(spark, folder), ["lang"]), skip=("threshold",))


@query(
    "roc_curve",
    with_sql(SCORED, RANKING) + """
    SELECT lang, y_score AS threshold, round(coalesce(cfp / nullif(n, 0)::DOUBLE, 0), 6) AS fpr,
           round(coalesce(ctp / nullif(p, 0)::DOUBLE, 0), 6) AS tpr FROM reached""",
)
def roc_curve(spark, folder):
    return rounded(mt.roc_curve(scored_documents(spark, folder), ["lang"]), skip=("threshold",))


def _fold_results(spark, folder, side):
    """Fold results made from line items: per return flag, supplier and line number.

    Metrics are shares of counts, so every engine computes the same doubles.
    """
    items = table(spark, folder, "lineitem")
    if side:
        items = items.where(F.col("l_linestatus") == side)
    n = F.count("*")

    def share(condition: str):
        return F.count_if(F.expr(condition)) / n

    return items.groupBy(
        F.concat(F.lit("model_"), F.col("l_returnflag")).alias("model"),
        F.col("l_suppkey").alias("repeat"),
        F.col("l_linenumber").cast("long").alias("fold"),
    ).agg(
        share("l_quantity >= 25").alias("pr_auc"),
        share("l_discount >= 0.05").alias("recall"),
        share("l_tax >= 0.04").alias("precision"),
        share("l_extendedprice >= 50000").alias("f1"),
        share("l_extendedprice < 30000").alias("accuracy"),
        share("l_discount < 0.03").alias("specificity"),
        share("l_tax < 0.06").alias("roc_auc"),
        share("l_quantity < 30").alias("balanced_accuracy"),
        (F.count_if(F.expr("l_quantity >= 40")) / 4.0).alias("fit_seconds"),
        (F.count_if(F.expr("l_quantity < 10")) / 4.0).alias("predict_seconds"),
        F.when(F.count_if(F.expr("l_discount > 0.09")) > 5, "error").otherwise("success").alias(
            "status"
        ),
    )


def _sql_folds(name: str, where: str) -> str:
    return f"""
{name} AS (
  SELECT 'model_' || l_returnflag AS model, l_suppkey AS repeat, l_linenumber::BIGINT AS fold,
         count(*) FILTER (l_quantity >= 25) / count(*)::DOUBLE AS pr_auc,
         count(*) FILTER (l_discount >= 0.05) / count(*)::DOUBLE AS recall,
         count(*) FILTER (l_tax >= 0.04) / count(*)::DOUBLE AS precision,
         count(*) FILTER (l_extendedprice >= 50000) / count(*)::DOUBLE AS f1,
         count(*) FILTER (l_extendedprice < 30000) / count(*)::DOUBLE AS accuracy,
         count(*) FILTER (l_discount < 0.03) / count(*)::DOUBLE AS specificity,
         count(*) FILTER (l_tax < 0.06) / count(*)::DOUBLE AS roc_auc,
         count(*) FILTER (l_quantity < 30) / count(*)::DOUBLE AS balanced_accuracy,
         count(*) FILTER (l_quantity >= 40) / 4.0::DOUBLE AS fit_seconds,
         count(*) FILTER (l_quantity < 10) / 4.0::DOUBLE AS predict_seconds,
         CASE WHEN count(*) FILTER (l_discount > 0.09) > 5 THEN 'error' ELSE 'success' END AS status
  FROM lineitem WHERE {where} GROUP BY 1, 2, 3)"""


ALL_FOLDS = _sql_folds("folds", "true")
OLD_FOLDS = _sql_folds("old", "l_linestatus = 'O'")
NEW_FOLDS = _sql_folds("new", "l_linestatus = 'F'")
FOUR = ("pr_auc", "recall", "precision", "f1")


@query(
    "metric_summary",
    with_sql(ALL_FOLDS) + "SELECT model, " + ", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std"
        for m in (*mt.METRICS, "fit_seconds", "predict_seconds")
    ) + " FROM folds GROUP BY 1",
)
def metric_summary(spark, folder):
    folds = _fold_results(spark, folder, None)
    return rounded(mt.summarize_folds(folds))


@query(
    "metric_summary_successful",
    with_sql(ALL_FOLDS) + " UNION ALL ".join(
        f"""SELECT model, '{m}' AS metric, round(avg({m}), 6) AS mean,
            round(coalesce(stddev_samp({m}), 0), 6) AS std, round(min({m}), 6) AS minimum,
            round(max({m}), 6) AS maximum FROM folds WHERE status = 'success' GROUP BY 1"""
        for m in mt.METRICS
    ),
)
def metric_summary_successful(spark, folder):
    folds = _fold_results(spark, folder, None)
    return rounded(mt.summarize_successful(folds))


@query(
    "run_status",
    with_sql(ALL_FOLDS) + """
    SELECT model, CASE WHEN count(*) FILTER (status = 'success') = 0 THEN 'error'
                       WHEN count(*) FILTER (status <> 'success') > 0 THEN 'partial_failure'
                       ELSE 'success' END AS status,
           count(*) FILTER (status = 'success') AS successful_folds,
           count(*) FILTER (status <> 'success') AS failed_folds,
           sum(fit_seconds) AS total_fit_seconds, sum(predict_seconds) AS total_predict_seconds
    FROM folds GROUP BY 1""",
)
def run_status(spark, folder):
    return mt.run_status(_fold_results(spark, folder, None))


@query(
    "baseline_outcomes",
    with_sql(ALL_FOLDS) + """
    SELECT model, 'success' AS status, round(avg(pr_auc), 6) AS primary_metric,
           round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision,
           sum(fit_seconds) AS fit_seconds, sum(predict_seconds) AS predict_seconds
    FROM folds GROUP BY 1""",
)
def baseline_outcomes(spark, folder):
    return rounded(mt.baseline_outcomes(_fold_results(spark, folder, None)))


PAIRS = """
pairs AS (
""" + " UNION ALL ".join(
    f"""SELECT old.model, old.repeat, old.fold, '{m}' AS metric, old.{m} AS reference,
        new.{m} AS candidate, new.{m} - old.{m} AS delta
        FROM old JOIN new USING (model, repeat, fold)"""
    for m in FOUR
) + ")"


def _pairs(spark, folder):
    return cp.paired_values(_fold_results(spark, folder, "O"), _fold_results(spark, folder, "F"))


@query(
    "paired_values",
    with_sql(OLD_FOLDS, NEW_FOLDS, PAIRS) + """
    SELECT model, repeat, fold, metric, round(reference, 6) AS reference,
           round(candidate, 6) AS candidate, round(delta, 6) + 0.0 AS delta FROM pairs""",
)
def paired_values(spark, folder):
    return rounded(_pairs(spark, folder))


@query(
    "paired_deltas",
    with_sql(OLD_FOLDS, NEW_FOLDS, PAIRS) + """
    SELECT model, metric, count(*) AS pairs, round(avg(reference), 6) AS reference_mean,
           round(avg(candidate), 6) AS candidate_mean, round(avg(delta), 6) + 0.0 AS mean_delta,
           round(stddev_samp(delta), 6) AS std_delta, count(*) FILTER (delta > 0) AS wins,
           count(*) FILTER (abs(delta) <= 1e-8) AS ties,
           round(median(delta), 6) + 0.0 AS median_delta
    FROM pairs GROUP BY 1, 2""",
)
def paired_deltas(spark, folder):
    return rounded(cp.paired_deltas(_pairs(spark, folder)))


SIGNED = """
nonzero AS (SELECT model, metric, delta, abs(delta) AS size FROM pairs WHERE delta <> 0),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY model, metric ORDER BY size)
            + (count(*) OVER (PARTITION BY model, metric, size) - 1) / 2.0::DOUBLE AS r,
         count(*) OVER (PARTITION BY model, metric, size) AS t
  FROM nonzero),
signed AS (
  SELECT model, metric, count(*) AS nonzero_pairs,
         sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w_plus,
         sum(CASE WHEN delta < 0 THEN r ELSE 0 END) AS w_minus,
         sum(power(t::DOUBLE, 2) - 1) AS tie_term
  FROM ranked GROUP BY 1, 2),
tests AS (
  SELECT s.*, z.zero_pairs, least(w_plus, w_minus) AS statistic
  FROM signed s JOIN (SELECT model, metric, count(*) FILTER (delta = 0) AS zero_pairs
                      FROM pairs GROUP BY 1, 2) z USING (model, metric))"""


@query(
    "signed_ranks",
    with_sql(OLD_FOLDS, NEW_FOLDS, PAIRS, SIGNED) + """
    SELECT model, metric, nonzero_pairs, zero_pairs, w_plus, w_minus, round(tie_term, 0) AS tie_term,
           statistic FROM tests""",
)
def signed_ranks(spark, folder):
    out = cp.signed_ranks(_pairs(spark, folder)).drop("all_zero")
    return out.withColumn("tie_term", F.round("tie_term", 0))


# The normal tail by the all-positive series of erf, since SQL has no erfc.
P_VALUES = """
z AS (
  SELECT *, abs(statistic - nonzero_pairs * (nonzero_pairs + 1) / 4.0::DOUBLE)
            / sqrt(nonzero_pairs * (nonzero_pairs + 1) * (2 * nonzero_pairs + 1) / 24.0::DOUBLE
                   - tie_term / 48) / sqrt(2::DOUBLE) AS x
  FROM tests),
p AS (
  SELECT model, metric, statistic, CASE WHEN x < 1e-12 THEN 1.0 ELSE
           1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 300),
             lambda k: exp((2 * k + 1) * ln(greatest(x, 1e-300)) + k * ln(2::DOUBLE)
               - ((k + 1) * ln(2::DOUBLE) + lgamma(k + 1.5) - 0.5 * ln(pi()))))) END AS p_value
  FROM z)"""


@query(
    "wilcoxon_test",
    with_sql(OLD_FOLDS, NEW_FOLDS, PAIRS, SIGNED, P_VALUES)
    + "SELECT model, metric, statistic, round(p_value, 8) AS p_value FROM p",
)
def wilcoxon_test(spark, folder):
    out = cp.wilcoxon(_pairs(spark, folder))
    return rounded(out.select("model", "metric", "statistic", "p_value"), 8, skip=("statistic",))


@query(
    "paired_comparison",
    with_sql(OLD_FOLDS, NEW_FOLDS, PAIRS, SIGNED, P_VALUES) + """
    , holm AS (
      SELECT *, max(raw) OVER (ORDER BY p_value, model, metric) AS p_value_holm FROM (
        SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, model, metric)
                              + 1) * p_value) AS raw FROM p))
    SELECT model, metric, count(*) AS pairs, round(avg(delta), 6) + 0.0 AS mean_delta,
           max(statistic) AS statistic, round(max(p_value), 7) AS p_value,
           round(max(p_value_holm), 7) AS p_value_holm, max(p_value_holm) < 0.05 AS significant
    FROM holm JOIN pairs USING (model, metric) GROUP BY 1, 2""",
)
def paired_comparison(spark, folder):
    out = cp.compare_pipelines(
        _fold_results(spark, folder, "O"), _fold_results(spark, folder, "F")
    )
    return out.select(
        "model", "metric", "pairs", (F.round("mean_delta", 6) + 0.0).alias("mean_delta"),
        "statistic", F.round("p_value", 7).alias("p_value"),
        F.round("p_value_holm", 7).alias("p_value_holm"), "significant",
    )


@query(
    "holm_adjust",
    """WITH t AS (SELECT l_suppkey, l_linenumber::BIGINT AS l_linenumber,
                         power(min(l_tax) + min(l_discount) + count(*) / 10000.0::DOUBLE, 2) AS p_value
                  FROM lineitem GROUP BY 1, 2),
       r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value) + 1)
                                  * p_value) AS raw FROM t)
       SELECT l_suppkey, l_linenumber, round(p_value, 9) AS p_value,
              round(max(raw) OVER (ORDER BY p_value ROWS UNBOUNDED PRECEDING), 9) AS p_value_holm,
              max(raw) OVER (ORDER BY p_value ROWS UNBOUNDED PRECEDING) < 0.05 AS significant
       FROM r""",
)
def holm_adjust(spark, folder):
    tests = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        F.pow(F.min("l_tax") + F.min("l_discount") + F.count("*") / 10000.0, F.lit(2)).alias(
            "p_value"
        )
    )
    return rounded(cp.holm_adjust(tests), 9)


# Student's 97.5 % point with pairs - 1 degrees of freedom, as a series around the normal point.
T_POINT = """(CASE pairs WHEN 1 THEN NULL WHEN 2 THEN 12.706204736174698 WHEN 3 THEN 4.302652729749464
  ELSE 1.959963984540054 + 2.372271230298562 / (pairs - 1) + 2.8224986157396112 / pow(pairs - 1, 2)
       + 2.555849679507722 / pow(pairs - 1, 3) + 1.5895340533938225 / pow(pairs - 1, 4) END)"""


@query(
    "effect_sizes",
    with_sql(OLD_FOLDS, NEW_FOLDS, PAIRS, SIGNED) + f"""
    SELECT model, metric, pairs, round(m, 6) + 0.0 AS mean_delta,
           round(m - {T_POINT} * s / sqrt(pairs), 6) + 0.0 AS low,
           round(m + {T_POINT} * s / sqrt(pairs), 6) + 0.0 AS high,
           round((w_plus - w_minus) / (w_plus + w_minus), 6) + 0.0 AS rank_biserial
    FROM (SELECT model, metric, count(*) AS pairs, avg(delta) AS m, stddev_samp(delta) AS s
          FROM pairs GROUP BY 1, 2) JOIN tests USING (model, metric)""",
)
def effect_sizes(spark, folder):
    return rounded(cp.effect_sizes(_pairs(spark, folder)))


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS rows
       FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(spark, folder):
    items = table(spark, folder, "lineitem")
    return rounded(cp.duplicate_keys(items, ["l_orderkey", "l_linenumber"]))


@query(
    "unpaired_keys",
    """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'),
            b AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F')
       SELECT k, 'left' AS present_in FROM a WHERE k NOT IN (SELECT k FROM b)
       UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""",
)
def unpaired_keys(spark, folder):
    a = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("k")
    ).distinct()
    b = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("k")
    )
    return cp.unpaired_keys(a, b, ["k"])


def _pipeline_metrics(spark, folder):
    """Metrics of each language by two scores: the document's length and its number."""
    docs = scored_documents(spark, folder)
    other = docs.withColumn("y_score", (F.col("doc_id") % 97) / 97.0)
    parts = [
        mt.classification_metrics(rows, ["lang"], single_class="null").select(
            F.lit(name).alias("pipeline"), F.col("lang").alias("model"), "recall", "accuracy"
        )
        for name, rows in (("fixed", docs), ("plan", other))
    ]
    return parts[0].unionByName(parts[1])


PIVOT = SCORED + """,
two_scores AS (SELECT lang, y_true, y_score AS fixed, doc_id % 97 / 97.0::DOUBLE AS plan FROM scored),
sides AS (
  SELECT lang AS model, coalesce(count(*) FILTER (y_true = 1 AND fixed >= 0.5)
           / nullif(count(*) FILTER (y_true = 1), 0)::DOUBLE, 0) AS fixed,
         coalesce(count(*) FILTER (y_true = 1 AND plan >= 0.5)
           / nullif(count(*) FILTER (y_true = 1), 0)::DOUBLE, 0) AS plan
  FROM two_scores GROUP BY 1)"""


@query(
    "metric_pivot",
    with_sql(PIVOT) + """
    SELECT model, round(fixed, 6) AS fixed, round(plan, 6) AS plan,
           round(plan - fixed, 6) + 0.0 AS delta FROM sides""",
)
def metric_pivot(spark, folder):
    return rounded(rp.metric_pivot(_pipeline_metrics(spark, folder), "recall", ("fixed", "plan")))


@query(
    "incomplete_report_pairs",
    """WITH found AS (SELECT n.n_name AS model, c.c_mktsegment AS pipeline, count(*) AS rows
                      FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2),
       wanted AS (SELECT n_name AS model, s AS pipeline FROM nation,
                  (SELECT unnest(['BUILDING', 'MACHINERY', 'NONE']) AS s))
       SELECT coalesce(w.model, f.model) AS model, coalesce(w.pipeline, f.pipeline) AS pipeline,
              coalesce(rows, 0) AS rows
       FROM wanted w FULL JOIN found f ON w.model = f.model AND w.pipeline = f.pipeline
       WHERE coalesce(rows, 0) <> 1 OR w.model IS NULL""",
)
def incomplete_report_pairs(spark, folder):
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("model"))
    found = table(spark, folder, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("model", F.col("c_mktsegment").alias("pipeline"))
    names = [r["model"] for r in nations.select("model").collect()]
    return rp.incomplete_pairs(found, names, ["BUILDING", "MACHINERY", "NONE"])


@query(
    "metrics_csv_roundtrip",
    with_sql(CONFUSION) + f"SELECT lang, tn, fp, fn, tp, {RATES_LIST} FROM rates",
)
def metrics_csv_roundtrip(spark, folder):
    counts = mt.confusion_counts(scored_documents(spark, folder), ["lang"])
    result = mt.threshold_metrics(counts)
    path = scratch(spark, "metrics")
    src.write_csv(result, path)
    return rounded(src.read_csv(spark, path, result.schema))


@query(
    "predictions_parquet_roundtrip",
    with_sql(SCORED) + "SELECT doc_id, lang, y_true::BIGINT AS y_true, y_score FROM scored",
)
def predictions_parquet_roundtrip(spark, folder):
    path = scratch(spark, "predictions")
    rows = scored_documents(spark, folder).drop("source")
    src.write_parquet(rows, path)
    return rounded(spark.read.parquet(path), skip=("y_score",))


@query(
    "strict_json_roundtrip",
    """SELECT event_id, CASE WHEN value >= 50 THEN ln(value - 49.5) END AS score
       FROM (SELECT event_id, value FROM events)""".replace(
        "ln(value - 49.5)", "round(ln(value - 49.5), 9)"
    ),
)
def strict_json_roundtrip(spark, folder):
    x = F.col("value")
    score = (
        F.when(x < 25, F.lit(float("nan")))
        .when(x < 50, F.lit(float("inf")))
        .otherwise(F.round(F.log(x - 49.5), 9))
    )
    rows = table(spark, folder, "events").select("event_id", score.alias("score"))
    path = scratch(spark, "scores")
    src.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


# Negatives to each positive, folds and repeats of the comparison of models, which are fitted with
# the settings of training.estimators.
RATIO, SPLITS, REPEATS = 10, 5, 5
TARGET = "isFraud"
KEY = ["event_id"]


def _model_table(spark, folder):
    rows = prepare_features(transactions(spark, folder))
    # The label is a threshold on the amount, so the amount itself would give it away.
    return rows.select(*KEY, TARGET, *[c for c in MODEL_FEATURES if "amount" not in c])


def _numeric():
    return tuple(c for c in MODEL_FEATURES if c != "type" and "amount" not in c)


def _robust_plan():
    return Plan(
        "robust", "events", 1,
        (
            Action("fill", "impute_categorical", ("type",), {"strategy": "most_frequent"}),
            Action("hot", "one_hot_encode", ("type",), {"handle_unknown": "ignore"}),
            Action("scale", "scale_numeric", ("step", "hour", "day"), {"method": "robust"},
                   "logistic_regression"),
            Action("balance", "resample_classes", (),
                   {"method": "random_undersampling", "random_seed": 42}),
        ),
    )


def _benchmark(spark, folder, plan):
    sample = case_control_sample(_model_table(spark, folder), TARGET, KEY, RATIO, 42)
    return sample, benchmark(sample, plan, TARGET, KEY, SPLITS, REPEATS)


def _coverage(result, by):
    valid = F.col("y_score").between(0, 1)
    return rounded(
        result.predictions.where(valid)
        .groupBy(*by)
        .agg(F.count_distinct("event_id").alias("rows"), F.sum("y_true").alias("positives"))
    )


@query("ml_benchmark")
def ml_benchmark(spark, folder):
    """Metrics of all folds; a fold that fails is an error of the query, as a row less would look like a result."""
    _, result = _benchmark(spark, folder, fixed_plan("events", ("type",), _numeric()))
    return result.complete_metrics


@query(
    "ml_oof_coverage",
    with_sql(TX) + """
    , sample AS (
      SELECT "isFraud" FROM tx WHERE "isFraud" = 1
      UNION ALL
      (SELECT "isFraud" FROM tx WHERE "isFraud" = 0
       QUALIFY row_number() OVER (ORDER BY md5('42|' || event_id))
         <= 10 * (SELECT count(*) FROM tx WHERE "isFraud" = 1)))
    SELECT m AS model, CAST(repeat AS BIGINT) AS repeat, count(*) AS rows,
           CAST(sum("isFraud") AS BIGINT) AS positives
    FROM sample, (SELECT unnest(['logistic_regression', 'decision_tree', 'random_forest']) AS m),
         (SELECT unnest([1, 2, 3, 4, 5]) AS repeat)
    GROUP BY 1, 2""",
)
def ml_oof_coverage(spark, folder):
    """Out-of-fold scores cover every row once per model and repeat."""
    _, result = _benchmark(spark, folder, fixed_plan("events", ("type",), _numeric()))
    return _coverage(result, ["model", "repeat"])


@query(
    "ml_oof_coverage_repeated",
    with_sql(TX) + """
    , sample AS (
      SELECT event_id, "isFraud" FROM tx WHERE "isFraud" = 1
      UNION ALL
      (SELECT event_id, "isFraud" FROM tx WHERE "isFraud" = 0
       QUALIFY row_number() OVER (ORDER BY md5('42|' || event_id))
         <= 10 * (SELECT count(*) FROM tx WHERE "isFraud" = 1))),
    folds AS (
      SELECT "isFraud", repeat, (row_number() OVER (PARTITION BY repeat, "isFraud"
               ORDER BY md5('42|' || repeat || '|' || event_id)) - 1) % 5 + 1 AS fold
      FROM sample, (SELECT unnest([1, 2, 3, 4, 5]) AS repeat))
    SELECT m AS model, CAST(repeat AS BIGINT) AS repeat, fold, count(*) AS rows,
           CAST(sum("isFraud") AS BIGINT) AS positives
    FROM folds, (SELECT unnest(['logistic_regression', 'decision_tree', 'random_forest']) AS m)
    GROUP BY 1, 2, 3""",
)
def ml_oof_coverage_repeated(spark, folder):
    """The same by fold."""
    _, result = _benchmark(spark, folder, fixed_plan("events", ("type",), _numeric()))
    return _coverage(result, ["model", "repeat", "fold"])


@query(
    "fold_failures",
    with_sql(TX) + """
    , folds AS (SELECT *, CAST(1 + (step >= 2 * (SELECT max(step) FROM tx) / 3)::INT
                               + (step >= (SELECT max(step) FROM tx))::INT AS BIGINT) AS fold
                FROM tx WHERE step < (SELECT max(step) FROM tx) OR "isFraud" = 0),
    sizes AS (SELECT fold, count(*) AS n, count(DISTINCT "isFraud") AS classes FROM folds GROUP BY fold)
    SELECT 'decision_tree' AS model, CAST(1 AS BIGINT) AS repeat, fold,
           CAST((SELECT sum(n) FROM sizes) - n AS BIGINT) AS train_rows, n AS validation_rows,
           CASE WHEN classes = 2 THEN 'success' ELSE 'error' END AS status,
           CASE WHEN classes < 2 THEN 'ValueError' END AS error_type, classes = 2 AS scored
    FROM sizes""",
)
def fold_failures(spark, folder):
    """Folds by time, the last of them without positives: an error row beside the others."""
    rows = prepare_features(transactions(spark, folder))
    last = rows.agg(F.max("step")).first()[0]
    sample = rows.where((F.col("step") < last) | (F.col(TARGET) == 0))
    fold = 1 + (F.col("step") >= F.lit(2 * last / 3)).cast("int") + (F.col("step") >= last).cast("int")
    assigned = sample.select(*KEY, TARGET, F.lit(1).alias("repeat"), fold.alias("fold"))
    sample = sample.select(*KEY, TARGET, *[c for c in MODEL_FEATURES if "amount" not in c])
    plan = fixed_plan("events", ("type",), _numeric())
    result = benchmark(sample, plan, TARGET, KEY, 3, 1, models=["decision_tree"], assigned=assigned)
    return rounded(
        result.fold_results.select(
            "model", "repeat", "fold", "train_rows", "validation_rows", "status", "error_type",
            F.col("pr_auc").isNotNull().alias("scored"),
        )
    )


@query("plan_benchmark_summary")
def plan_benchmark_summary(spark, folder):
    _, result = _benchmark(spark, folder, _robust_plan())
    return mt.summarize_successful(result.fold_results)


@query("candidate_evidence")
def candidate_evidence_query(spark, folder):
    plan = _robust_plan()
    sample, result = _benchmark(spark, folder, plan)
    return candidate_evidence("events", 1, plan, sample, result, KEY)[1]


@query("holdout_compare")
def holdout_compare(spark, folder):
    development, held = split_temporally(_model_table(spark, folder))
    sample = case_control_sample(development, TARGET, KEY, RATIO, 42)
    plans = {"fixed": fixed_plan("events", ("type",), _numeric()), "plan": _robust_plan()}
    return compare_on_holdout(sample, held, plans, TARGET, KEY)[0]
