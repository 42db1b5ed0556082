"""Queries on plan parsing, audit, application and gating."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalogue.common import (
    DEGRADED,
    TX,
    degraded,
    query,
    rounded,
    table,
    transactions,
    with_sql,
)
from plumbline.operators.report import quality_runtime_table
from plumbline.plans import gating as gt
from plumbline.plans.application import Action, Plan, apply_plan, learn_plan, plan_quality
from plumbline.plans.audit import audit_plans, columns_catalog, plan_verdicts
from plumbline.plans.parsing import parse_plans

KINDS = {"event_id": "numeric", "amount": "numeric", "type": "categorical", "isFraud": "target"}


def plan_documents(spark, folder):
    """One JSON plan per part, with the defects its attributes call for."""
    brand = "cast(substring(p_brand, 7) AS int)"
    columns = """CASE WHEN p_size <= 10 THEN '["amount"]' WHEN p_size <= 20 THEN '["type"]'
        WHEN p_size <= 30 THEN '["amount","isFraud"]' WHEN p_size <= 40 THEN '["missing"]'
        ELSE '[]' END"""
    parameters = f"""CASE WHEN {brand} <= 5 THEN '{{"strategy":"median"}}'
        WHEN {brand} <= 10 THEN '{{"strategy":"constant"}}'
        WHEN {brand} <= 15 THEN '{{"method":"robust","extra":true}}'
        WHEN {brand} <= 20 THEN '{{"method":"smote","random_seed":42}}'
        ELSE '{{"method":"smote","random_seed":"42","handle_unknown":"error"}}' END"""
    kind = """CASE p_type WHEN 'ECONOMY' THEN 'impute_numeric' WHEN 'LARGE' THEN 'impute_categorical'
        WHEN 'MEDIUM' THEN 'scale_numeric' WHEN 'PROMO' THEN 'one_hot_encode'
        WHEN 'SMALL' THEN 'resample_classes' ELSE 'execute_code' END"""

    def action(action_id: str, scope: str) -> str:
        return f"""concat('{{"action_id":"', {action_id}, '","transformation":"', {kind},
            '","columns":', {columns}, ',"parameters":', {parameters},
            ',"rationale":"from part","model_scope":"', {scope}, '"}}')"""

    first = action("'a1'", "'all'")
    second = action(
        "CASE WHEN p_size = 50 THEN 'a1' ELSE 'a2' END",
        "CASE WHEN p_retailprice >= 1500 THEN 'all' ELSE 'random_forest' END",
    )
    text = f"""concat('{{"plan_id":"', CASE WHEN p_size = 13 THEN 'plan ' ELSE 'plan-' END, p_partkey,
        '","dataset_id":"', CASE WHEN p_brand = 'Brand#3' THEN 'other' ELSE 'events' END,
        '","iteration":', p_size - 1, ',"objective":"', p_type, '"',
        CASE WHEN p_brand = 'Brand#7' THEN ',"note":1' ELSE '' END,
        ',"actions":[', {first}, ',', {second}, ']',
        CASE WHEN p_size = 27 THEN '' ELSE '}}' END)"""
    return table(spark, folder, "part").select(
        "p_partkey",
        F.expr(
            "CASE WHEN p_size <= 45 THEN 'development' WHEN p_size <= 48 THEN 'validation_fold' "
            "ELSE 'temporal_test' END"
        ).alias("role"),
        F.expr(text).alias("plan_json"),
    )


@query(
    "plan_shape_errors",
    """SELECT p_partkey, 'malformed_json' AS code, 'plan' AS detail FROM part WHERE p_size = 27
       UNION ALL SELECT p_partkey, 'invalid_field', 'plan_id' FROM part WHERE p_size = 13
       UNION ALL SELECT p_partkey, 'invalid_field', 'iteration' FROM part WHERE p_size = 1
       UNION ALL SELECT p_partkey, 'repeated_action_id', 'actions' FROM part WHERE p_size = 50
       UNION ALL SELECT p_partkey, 'unknown_field', 'note' FROM part
                 WHERE p_brand = 'Brand#7' AND p_size <> 27""",
)
def plan_shape_errors(spark, folder):
    parsed = parse_plans(plan_documents(spark, folder))
    return parsed.select("p_partkey", F.inline("shape_errors"))


PLANS = """
plans AS (
  SELECT 'plan-' || p_partkey AS plan_id,
         CASE WHEN p_brand = 'Brand#3' THEN 'other' ELSE 'events' END AS dataset_id,
         CASE WHEN p_size <= 45 THEN 'development' WHEN p_size <= 48 THEN 'validation_fold'
              ELSE 'temporal_test' END AS role,
         CASE p_type WHEN 'ECONOMY' THEN 'impute_numeric' WHEN 'LARGE' THEN 'impute_categorical'
              WHEN 'MEDIUM' THEN 'scale_numeric' WHEN 'PROMO' THEN 'one_hot_encode'
              WHEN 'SMALL' THEN 'resample_classes' ELSE 'execute_code' END AS t,
         CASE WHEN p_size <= 10 THEN ['amount'] WHEN p_size <= 20 THEN ['type']
              WHEN p_size <= 30 THEN ['amount', 'isFraud'] WHEN p_size <= 40 THEN ['missing']
              ELSE []::VARCHAR[] END AS cols,
         least((CAST(substr(p_brand, 7) AS INT) + 4) // 5, 5) AS g,
         p_retailprice >= 1500 AS repeats
  FROM part WHERE p_size NOT IN (1, 13, 27, 50) AND p_brand <> 'Brand#7'),
actions AS (
  SELECT *, 'a1' AS action_id, false AS is_repeat FROM plans
  UNION ALL SELECT *, 'a2', repeats FROM plans),
allowed AS (SELECT * FROM actions WHERE t <> 'execute_code'),
cells AS (SELECT plan_id, action_id, t, unnest(cols) AS c FROM allowed),
given AS (
  SELECT plan_id, action_id, t, g, unnest(CASE g
    WHEN 1 THEN ['strategy'] WHEN 2 THEN ['strategy'] WHEN 3 THEN ['method', 'extra']
    WHEN 4 THEN ['method', 'random_seed'] ELSE ['method', 'random_seed', 'handle_unknown'] END) AS k
  FROM allowed),
accepted AS (SELECT * FROM (VALUES
  ('impute_numeric', 'strategy'), ('impute_categorical', 'strategy'),
  ('impute_categorical', 'fill_value'), ('scale_numeric', 'method'),
  ('one_hot_encode', 'handle_unknown'), ('resample_classes', 'method'),
  ('resample_classes', 'random_seed')) AS a(t, k)),
issues AS (
  SELECT plan_id, '' AS action_id, 'temporal_test_access_forbidden' AS code, role AS detail
  FROM plans WHERE role = 'temporal_test'
  UNION ALL SELECT plan_id, '', 'dataset_mismatch', dataset_id FROM plans WHERE dataset_id <> 'events'
  UNION ALL SELECT plan_id, action_id, 'transformation_not_allowed', t FROM actions
            WHERE t = 'execute_code'
  UNION ALL SELECT plan_id, action_id, 'column_not_found', c FROM cells WHERE c = 'missing'
  UNION ALL SELECT plan_id, action_id, 'protected_column_reference', c FROM cells WHERE c = 'isFraud'
  UNION ALL SELECT plan_id, action_id, 'incompatible_column_type', c FROM cells
            WHERE c <> 'missing' AND NOT (c = 'amount' AND t IN ('impute_numeric', 'scale_numeric')
              OR c = 'type' AND t IN ('impute_categorical', 'one_hot_encode'))
  UNION ALL SELECT plan_id, action_id, 'sampling_outside_training_forbidden', t FROM allowed
            WHERE t = 'resample_classes' AND role = 'validation_fold'
  UNION ALL SELECT plan_id, action_id, 'columns_required', t FROM allowed
            WHERE t <> 'resample_classes' AND len(cols) = 0
  UNION ALL SELECT plan_id, action_id, 'columns_not_allowed', t FROM allowed
            WHERE t = 'resample_classes' AND len(cols) > 0
  UNION ALL SELECT plan_id, action_id, 'duplicate_action', t FROM allowed WHERE is_repeat
  UNION ALL SELECT plan_id, action_id, 'unknown_parameter', string_agg(k, ',' ORDER BY k)
            FROM given WHERE (t, k) NOT IN (SELECT (t, k) FROM accepted) GROUP BY 1, 2
  UNION ALL SELECT plan_id, action_id, 'invalid_parameter', 'strategy' FROM allowed
            WHERE t = 'impute_numeric' AND g <> 1 OR t = 'impute_categorical' AND g <> 2
  UNION ALL SELECT plan_id, action_id, 'invalid_parameter', 'method' FROM allowed
            WHERE t = 'scale_numeric' AND g <> 3 OR t = 'resample_classes' AND g < 4
  UNION ALL SELECT plan_id, action_id, 'invalid_parameter', 'random_seed' FROM allowed
            WHERE t = 'resample_classes' AND g <> 4
  UNION ALL SELECT plan_id, action_id, 'missing_parameter', 'fill_value' FROM allowed
            WHERE t = 'impute_categorical' AND g = 2
  UNION ALL SELECT plan_id, action_id, 'unsafe_parameter', 'handle_unknown' FROM allowed
            WHERE t = 'one_hot_encode' AND g = 5)"""


def _well_formed(spark, folder):
    parsed = parse_plans(plan_documents(spark, folder)).where(F.size("shape_errors") == 0)
    catalog = columns_catalog(
        transactions(spark, folder).select(*KINDS), KINDS, ["event_id"]
    )
    return parsed, catalog


@query("plan_audit", with_sql(PLANS) + "SELECT plan_id, action_id, code, detail FROM issues")
def plan_audit(spark, folder):
    parsed, catalog = _well_formed(spark, folder)
    return audit_plans(parsed, catalog, "events", F.col("role")).withColumn(
        "action_id", F.coalesce("action_id", F.lit(""))
    )


@query(
    "plan_verdicts",
    with_sql(PLANS) + """
    SELECT plans.plan_id, count(code) AS issue_count, count(code) = 0 AS is_valid
    FROM plans LEFT JOIN issues ON plans.plan_id = issues.plan_id GROUP BY 1""",
)
def plan_verdicts_query(spark, folder):
    parsed, catalog = _well_formed(spark, folder)
    return rounded(plan_verdicts(parsed, catalog, "events", F.col("role")))


@query(
    "plan_iteration_mismatches",
    """SELECT 'plan-' || p_partkey AS plan_id, '' AS action_id, 'iteration_mismatch' AS code,
              CAST(p_size - 1 AS VARCHAR) AS detail
       FROM part WHERE p_size NOT IN (1, 13, 27, 50) AND p_brand <> 'Brand#7' AND p_size - 1 <> 12""",
)
def plan_iteration_mismatches(spark, folder):
    """Plans that answer for another attempt than the twelfth."""
    parsed, catalog = _well_formed(spark, folder)
    found = audit_plans(parsed, catalog, "events", F.col("role"), iteration=12)
    return found.where("code = 'iteration_mismatch'").withColumn("action_id", F.lit(""))


@query(
    "plan_audit_datasets",
    with_sql(PLANS) + """
    SELECT plan_id, action_id, 'column_not_found' AS code, c AS detail
    FROM cells JOIN (SELECT plan_id, dataset_id FROM plans) USING (plan_id)
    WHERE c NOT IN (SELECT unnest(CASE dataset_id WHEN 'other' THEN ['amount'] ELSE ['amount', 'type', 'isFraud'] END))""",
)
def plan_audit_datasets(spark, folder):
    """Columns looked up in the catalogue of each plan's own dataset."""
    parsed, _ = _well_formed(spark, folder)
    tx = transactions(spark, folder)
    catalog = columns_catalog(tx.select(*KINDS), KINDS, ["event_id"], "events").unionByName(
        columns_catalog(tx.select("amount", "step"), {"amount": "numeric", "step": "target"}, (), "other")
    )
    found = audit_plans(parsed, catalog, F.col("dataset_id"), F.col("role"))
    return found.where("code = 'column_not_found'")


REPAIR = Plan(
    "repair", "events", 1,
    (
        Action("fill_type", "impute_categorical", ("type",), {"strategy": "most_frequent"}),
        Action("fill_amount", "impute_numeric", ("amount",), {"strategy": "median"}),
        Action("log", "log_transform", ("amount",), {}),
        Action("scale", "scale_numeric", ("amount",), {"method": "standard"},
               "logistic_regression"),
        Action("hot", "one_hot_encode", ("type",), {"handle_unknown": "ignore"}),
    ),
)


@query(
    "apply_plan",
    with_sql(TX, DEGRADED) + """
    , filled AS (
      SELECT event_id, coalesce(type, (SELECT type FROM degraded WHERE type IS NOT NULL
               GROUP BY type ORDER BY count(*) DESC, type LIMIT 1)) AS type,
             ln(1 + coalesce(amount, (SELECT median(amount) FROM degraded))) AS amount
      FROM degraded)
    SELECT event_id, round((amount - avg(amount) OVER ()) / stddev_pop(amount) OVER (), 6) AS amount,
           CAST(type = 'CASH_IN' AS BIGINT) AS "type=CASH_IN",
           CAST(type = 'CASH_OUT' AS BIGINT) AS "type=CASH_OUT",
           CAST(type = 'DEBIT' AS BIGINT) AS "type=DEBIT",
           CAST(type = 'PAYMENT' AS BIGINT) AS "type=PAYMENT",
           CAST(type = 'TRANSFER' AS BIGINT) AS "type=TRANSFER"
    FROM filled""",
)
def apply_plan_query(spark, folder):
    rows = degraded(spark, folder).select("event_id", "type", "amount")
    return rounded(apply_plan(rows, REPAIR, "logistic_regression"))


@query(
    "apply_plan_other_scope",
    with_sql(TX, DEGRADED) + """
    SELECT event_id, round(ln(1 + coalesce(amount, (SELECT median(amount) FROM degraded))), 6)
      AS amount FROM degraded""",
)
def apply_plan_other_scope(spark, folder):
    rows = degraded(spark, folder).select("event_id", "type", "amount")
    learned = learn_plan(rows, REPAIR, "decision_tree")
    return rounded(learned.transform(rows).select("event_id", "amount"))


PLAN_QUALITY = """
stages AS (
  SELECT 'before' AS stage, step, type, amount, "isFraud" FROM degraded
  UNION ALL
  SELECT 'after', step, coalesce(type, (SELECT type FROM degraded WHERE type IS NOT NULL
           GROUP BY type ORDER BY count(*) DESC, type LIMIT 1)),
         coalesce(amount, (SELECT median(amount) FROM degraded)), "isFraud" FROM degraded),
quality AS (
  SELECT stage, count(*) AS rows,
         count(*) FILTER (type IS NULL) + count(*) FILTER (amount IS NULL) AS missing_cells,
         count(*) - count(DISTINCT (step, coalesce(type, ''), coalesce(amount, -1), "isFraud"))
           AS duplicate_rows
  FROM stages GROUP BY 1)"""


@query(
    "plan_quality_before_after",
    with_sql(TX, DEGRADED, PLAN_QUALITY) + """
    SELECT stage, rows, missing_cells, duplicate_rows,
           round(0.3 * (1 - missing_cells / (rows * 4.0)) + 0.5 + 0.2 * (1 - duplicate_rows / (rows * 1.0)), 9)
             AS data_quality_score
    FROM quality""",
)
def plan_quality_before_after(spark, folder):
    out = plan_quality(degraded(spark, folder).drop("event_id"), REPAIR)
    return rounded(
        out.select("stage", "rows", "missing_cells", "duplicate_rows", "data_quality_score"), 9
    )


@query(
    "quality_runtime_table",
    with_sql(TX, DEGRADED, PLAN_QUALITY) + """
    , scores AS (
      SELECT stage, 0.3 * (1 - missing_cells / (rows * 4.0)) + 0.5
                    + 0.2 * (1 - duplicate_rows / (rows * 1.0)) AS s FROM quality)
    SELECT round(b.s, 9) AS initial_data_quality_score, round(a.s, 9) AS selected_data_quality_score,
           round(a.s - b.s, 9) AS selected_quality_delta, 1.5::DOUBLE AS selected_runtime_multiplier
    FROM scores a, scores b WHERE a.stage = 'after' AND b.stage = 'before'""",
)
def quality_runtime_table_query(spark, folder):
    both = plan_quality(degraded(spark, folder).drop("event_id"), REPAIR)
    return rounded(
        quality_runtime_table(
            both.where("stage = 'before'"), both.where("stage = 'after'"), 1.5
        ),
        9,
    )


def run_history(spark, folder):
    """Customers as runs, their orders as attempts and three models scored by the price.

    All metrics are multiples of 1/1024, so their means are exact.
    """
    orders = table(spark, folder, "orders")
    from pyspark.sql import Window as W

    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    base = orders.select(
        F.col("o_custkey").alias("run_id"),
        (F.row_number().over(order) - 1).cast("long").alias("iteration"),
        F.concat(F.lit("plan-"), F.col("o_orderkey").cast("string")).alias("plan_id"),
        (F.col("o_orderpriority") != "5-LOW").alias("validation_valid"),
        F.expr(
            "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'fatal_error' "
            "WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 'recoverable_error' "
            "ELSE 'success' END"
        ).alias("execution_status"),
        F.concat(F.lit("data-"), F.col("o_orderstatus")).alias("dataset_id"),
        F.expr("cast(round(o_totalprice * 100) AS bigint)").alias("cents"),
    )
    candidates = base.select(
        "run_id", "iteration", "plan_id", "validation_valid", "execution_status", "dataset_id",
        F.expr("(cents % 512) / 512.0D").alias("data_quality_score"),
        F.expr("(cents % 64) / 16.0D").alias("preprocessing_seconds"),
    )
    outcomes = (
        base.select(
            "run_id", "iteration",
            F.expr(
                "inline(array(struct('m0' AS model, cents AS c), struct('m1' AS model, "
                "cents div 7 AS c), struct('m2' AS model, cents div 49 AS c)))"
            ),
        )
        .withColumn(
            "status",
            F.expr(
                "CASE WHEN c % 31 = 0 THEN 'error' WHEN c % 37 = 0 THEN 'partial_failure' "
                "ELSE 'success' END"
            ),
        )
        .select(
            "run_id", "iteration", "model", "status",
            F.expr("CASE WHEN status <> 'error' THEN (700 + c % 32) / 1024.0D END").alias(
                "primary_metric"
            ),
            F.expr("(900 + c % 24) / 1024.0D").alias("recall"),
            F.expr("(800 + (c div 3) % 23) / 1024.0D").alias("precision"),
            F.expr("1 + (c % 16) / 4.0D").alias("fit_seconds"),
            F.expr("(c % 8) / 8.0D").alias("predict_seconds"),
        )
    )
    return candidates, outcomes


POLICY = gt.GatePolicy(max_iterations=8, no_improvement_patience=3)

HISTORY = """
base AS (
  SELECT o_custkey AS run_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS iteration,
         'plan-' || o_orderkey AS plan_id, o_orderpriority <> '5-LOW' AS validation_valid,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'fatal_error'
              WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 'recoverable_error'
              ELSE 'success' END AS execution_status,
         'data-' || o_orderstatus AS dataset_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders),
split AS (
  SELECT run_id, iteration, 'm0' AS model, cents AS c FROM base
  UNION ALL SELECT run_id, iteration, 'm1', cents // 7 FROM base
  UNION ALL SELECT run_id, iteration, 'm2', cents // 49 FROM base),
outcomes AS (
  SELECT *, CASE WHEN c % 31 = 0 THEN 'error' WHEN c % 37 = 0 THEN 'partial_failure'
                 ELSE 'success' END AS status,
         (700 + c % 32) / 1024.0::DOUBLE AS metric, (900 + c % 24) / 1024.0::DOUBLE AS recall,
         (800 + (c // 3) % 23) / 1024.0::DOUBLE AS precision,
         1 + (c % 16) / 4.0::DOUBLE + (c % 8) / 8.0::DOUBLE AS seconds
  FROM split),
attempts AS (
  SELECT o.run_id, o.iteration, avg(o.metric) FILTER (o.status = 'success') AS mean_primary,
         sum(o.seconds) AS seconds, bool_or(o.status <> 'success') AS any_failed,
         list_sort(list_concat(
           coalesce(list('precision:' || o.model) FILTER (o.status = 'success'
             AND r.status = 'success' AND r.precision - o.precision > 0.02), []),
           coalesce(list('recall:' || o.model) FILTER (o.status = 'success'
             AND r.status = 'success' AND r.recall - o.recall > 0.02), []))) AS violations
  FROM outcomes o JOIN outcomes r ON r.run_id = o.run_id AND r.model = o.model AND r.iteration = 0
  GROUP BY 1, 2),
full_rows AS (
  SELECT b.run_id, b.iteration, plan_id, validation_valid, execution_status, dataset_id,
         mean_primary, any_failed, violations, (cents % 512) / 512.0::DOUBLE AS quality,
         (cents % 64) / 16.0::DOUBLE + seconds AS total_seconds
  FROM base b JOIN attempts a USING (run_id, iteration)),
evidence AS (
  SELECT c.*, c.mean_primary - z.mean_primary AS primary_delta, c.quality - z.quality AS quality_delta,
         c.total_seconds / z.total_seconds AS runtime_multiplier, z.mean_primary AS b_primary,
         lag(c.mean_primary) OVER w AS previous, row_number() OVER w AS place
  FROM full_rows c JOIN full_rows z ON z.run_id = c.run_id AND z.iteration = 0
  WHERE c.iteration > 0 WINDOW w AS (PARTITION BY c.run_id ORDER BY c.iteration)),
streaks AS (
  SELECT *, place - coalesce(max(CASE WHEN validation_valid THEN place END) OVER w, 0) AS bad,
         place - coalesce(max(CASE WHEN execution_status = 'success' THEN place END) OVER w, 0)
           AS failing,
         place - coalesce(max(CASE WHEN NOT validation_valid OR execution_status <> 'success'
           OR (place > 1 AND mean_primary - previous >= 0.005) THEN place END) OVER w, 0) AS idle
  FROM evidence WINDOW w AS (PARTITION BY run_id ORDER BY iteration)),
reasons AS (
  SELECT *, CASE WHEN NOT validation_valid THEN 'invalid_strategy'
                 WHEN execution_status <> 'success' THEN 'execution_error'
                 WHEN any_failed THEN 'model_evaluation_failure'
                 WHEN mean_primary IS NULL OR b_primary IS NULL THEN 'missing_metrics'
                 WHEN len(violations) > 0 THEN 'metric_guardrail_violation'
                 WHEN runtime_multiplier > 3 THEN 'excessive_runtime_cost'
                 WHEN primary_delta >= 0.005 OR (quality_delta >= 0.0001 AND primary_delta >= 0)
                   THEN 'improvement_accepted'
                 ELSE 'insufficient_improvement' END AS reason_code
  FROM streaks),
decisions AS (
  SELECT *, CASE WHEN reason_code = 'invalid_strategy' AND bad >= 2 THEN 'STOP_INVALID_STRATEGIES'
                 WHEN reason_code = 'execution_error' AND (execution_status = 'fatal_error'
                   OR failing >= 2) THEN 'STOP_EXECUTION_ERROR'
                 WHEN reason_code = 'improvement_accepted' THEN 'ACCEPT'
                 WHEN iteration >= 8 THEN 'STOP_MAX_ITERATIONS'
                 WHEN reason_code NOT IN ('invalid_strategy', 'execution_error') AND idle >= 3
                   THEN 'STOP_NO_IMPROVEMENT'
                 ELSE 'RETRY' END AS action,
         reason_code IN ('metric_guardrail_violation', 'excessive_runtime_cost',
                         'improvement_accepted', 'insufficient_improvement') AS compared
  FROM reasons)"""


def _decisions(spark, folder):
    return gt.gate_candidates(*run_history(spark, folder), POLICY)


@query(
    "attempt_evidence",
    with_sql(HISTORY) + """
    SELECT run_id, iteration, round(mean_primary, 9) AS mean_primary, total_seconds,
           round(primary_delta, 9) + 0.0 AS primary_delta, quality_delta,
           round(runtime_multiplier, 9) AS runtime_multiplier
    FROM evidence""",
)
def attempt_evidence(spark, folder):
    rows = gt.attempt_evidence(*run_history(spark, folder), POLICY)
    return rounded(
        rows.select(
            "run_id", "iteration", "mean_primary", "total_seconds", "primary_delta",
            "quality_delta", "runtime_multiplier",
        ),
        9,
    )


@query(
    "gate_candidates",
    with_sql(HISTORY) + """
    SELECT run_id, iteration, plan_id, validation_valid, action, reason_code,
           round(CASE WHEN compared THEN primary_delta END, 9) + 0.0 AS primary_delta,
           CASE WHEN compared THEN quality_delta END AS quality_delta,
           round(CASE WHEN compared THEN runtime_multiplier END, 9) AS runtime_multiplier,
           CASE WHEN compared THEN array_to_string(violations, ',') ELSE '' END AS violations,
           round(mean_primary, 9) AS mean_primary, action = 'ACCEPT' AS is_new_best
    FROM decisions""",
)
def gate_candidates(spark, folder):
    rows = _decisions(spark, folder).withColumn("violations", F.array_join("violations", ","))
    return rounded(rows, 9)


@query(
    "select_plan",
    with_sql(HISTORY) + """
    SELECT run_id, iteration, plan_id, action, round(mean_primary, 9) AS mean_primary
    FROM decisions WHERE action = 'ACCEPT' OR (validation_valid AND mean_primary IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY (action = 'ACCEPT')::INT DESC,
      CASE WHEN action = 'ACCEPT' THEN -iteration END, mean_primary DESC, iteration) = 1""",
)
def select_plan(spark, folder):
    return rounded(gt.select_plan(_decisions(spark, folder)), 9)


@query(
    "history_violations",
    with_sql(HISTORY) + """
    , marked AS (SELECT * EXCLUDE (mean_primary), CAST(substr(plan_id, 6) AS BIGINT) AS k,
                        CASE WHEN CAST(substr(plan_id, 6) AS BIGINT) % 7 > 0 THEN mean_primary END AS mean_primary
                 FROM decisions),
    seen AS (
      SELECT *, coalesce(lag(iteration) OVER w, 0) + 1 AS expected,
             coalesce(bool_or(action <> 'RETRY') OVER e, false) AS over_already,
             first(dataset_id) OVER e AS first_dataset
      FROM marked WINDOW w AS (PARTITION BY run_id ORDER BY iteration),
        e AS (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT run_id, iteration, 'not_sequential' AS violation FROM seen WHERE iteration <> expected
    UNION ALL SELECT run_id, iteration, 'after_terminal_decision' FROM seen WHERE over_already
    UNION ALL SELECT run_id, iteration, 'dataset_changed' FROM seen WHERE dataset_id <> first_dataset
    UNION ALL SELECT run_id, iteration, 'over_maximum' FROM seen WHERE iteration > 8
    UNION ALL SELECT run_id, iteration, 'plan_iteration_differs' FROM seen WHERE k % 53 = 0
    UNION ALL SELECT run_id, iteration, 'assessment_iteration_differs' FROM seen WHERE k % 59 = 0
    UNION ALL SELECT run_id, iteration, 'feedback_iteration_differs' FROM seen WHERE k % 61 = 0
    UNION ALL SELECT run_id, iteration, 'feedback_plan_differs' FROM seen WHERE k % 67 = 0
    UNION ALL SELECT run_id, iteration, 'best_without_metric' FROM seen
              WHERE action = 'ACCEPT' AND mean_primary IS NULL""",
)
def history_violations(spark, folder):
    candidates, outcomes = run_history(spark, folder)
    decided = gt.gate_candidates(candidates, outcomes, POLICY)
    named = decided.join(
        candidates.select("run_id", "iteration", "dataset_id"), ["run_id", "iteration"]
    )
    k = F.substring("plan_id", 6, 20).cast("long")

    def shifted(every):
        return F.col("iteration") + (k % every == 0).cast("int")

    return gt.history_violations(
        named.withColumns(
            {
                "max_iterations": F.lit(POLICY.max_iterations),
                "plan_iteration": shifted(53),
                "assessment_iteration": shifted(59),
                "feedback_iteration": shifted(61),
                "feedback_plan_id": F.when(k % 67 > 0, F.col("plan_id")),
                "mean_primary": F.when(k % 7 > 0, F.col("mean_primary")),
            }
        )
    )


@query(
    "selected_quality_runtime",
    with_sql(HISTORY) + """
    , chosen AS (SELECT run_id, iteration FROM decisions
      WHERE action = 'ACCEPT' OR (validation_valid AND mean_primary IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY (action = 'ACCEPT')::INT DESC,
        CASE WHEN action = 'ACCEPT' THEN -iteration END, mean_primary DESC, iteration) = 1)
    SELECT run_id, e.plan_id, z.quality AS initial_data_quality_score,
           e.quality AS selected_data_quality_score, e.quality_delta AS selected_quality_delta,
           round(e.runtime_multiplier, 9) AS selected_runtime_multiplier
    FROM chosen JOIN evidence e USING (run_id, iteration)
    JOIN full_rows z USING (run_id) WHERE z.iteration = 0""",
)
def selected_quality_runtime(spark, folder):
    candidates, outcomes = run_history(spark, folder)
    selected = gt.select_plan(gt.gate_candidates(candidates, outcomes, POLICY))
    evidence = gt.attempt_evidence(candidates, outcomes, POLICY)
    return rounded(gt.selected_costs(candidates, evidence, selected), 9)


@query(
    "best_so_far",
    with_sql(HISTORY) + """
    SELECT run_id, iteration, action,
           last_value(CASE WHEN action = 'ACCEPT' THEN plan_id END IGNORE NULLS) OVER w
             AS best_plan_id,
           coalesce(last_value(CASE WHEN action = 'ACCEPT' THEN iteration END IGNORE NULLS) OVER w, 0)
             AS best_iteration,
           round(last_value(CASE WHEN action = 'ACCEPT' THEN mean_primary END IGNORE NULLS) OVER w, 9)
             AS best_primary_metric
    FROM decisions WINDOW w AS (PARTITION BY run_id ORDER BY iteration
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def best_so_far(spark, folder):
    rows = gt.best_so_far(_decisions(spark, folder))
    return rounded(
        rows.withColumn("best_iteration", F.coalesce("best_iteration", F.lit(0))), 9
    )
