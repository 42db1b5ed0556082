import pytest

from plumbline.plans import gating as gt

CANDIDATES = ("run_id string, iteration int, plan_id string, validation_valid boolean, "
              "execution_status string, data_quality_score double, preprocessing_seconds double")
OUTCOMES = ("run_id string, iteration int, model string, status string, primary_metric double, "
            "recall double, precision double, fit_seconds double, predict_seconds double")


def history(spark, *attempts, models=("m1", "m2")):
    """Baseline plus attempts given as dictionaries of what differs from it."""
    cand, out = [], []
    for i, a in enumerate([{}, *attempts]):
        cand.append(("r", i, f"p{i}", a.get("valid", True), a.get("status", "success"),
                     a.get("quality", 0.90), 0.0))
        for m in a.get("models", models):
            failed = m in a.get("failed", ())
            out.append(("r", i, m, "partial_failure" if failed else "success", a.get("primary", 0.70),
                        a.get("recall", 0.80), a.get("precision", 0.70), a.get("seconds", 1.0), 0.0))
    return spark.createDataFrame(cand, CANDIDATES), spark.createDataFrame(out, OUTCOMES)


def decide(spark, *attempts, **policy):
    rows = gt.gate_candidates(*history(spark, *attempts), gt.GatePolicy(**policy))
    return rows.orderBy("iteration").collect()


def last(spark, *attempts, **policy):
    return decide(spark, *attempts, **policy)[-1]


def test_accept_gain(spark):
    r = last(spark, {"primary": 0.72})
    assert (r["action"], r["is_new_best"]) == ("ACCEPT", True)
    assert r["primary_delta"] == pytest.approx(0.02)


def test_accept_cleaner_data_at_equal_performance(spark):
    r = last(spark, {"quality": 0.91})
    assert r["action"] == "ACCEPT" and r["quality_delta"] == pytest.approx(0.01)


def test_guardrail(spark):
    r = last(spark, {"primary": 0.75, "recall": 0.70})
    assert (r["action"], r["reason_code"]) == ("RETRY", "metric_guardrail_violation")
    assert r["violations"] == ["recall:m1", "recall:m2"]


def test_runtime(spark):
    r = last(spark, {"primary": 0.75, "seconds": 5.0})
    assert (r["action"], r["reason_code"]) == ("RETRY", "excessive_runtime_cost")
    assert r["runtime_multiplier"] == 5.0


def test_stop_without_improvement(spark):
    rows = decide(spark, {"primary": 0.701}, {"primary": 0.702})
    assert [r["action"] for r in rows] == ["RETRY", "STOP_NO_IMPROVEMENT"]
    assert rows[1]["reason_code"] == "insufficient_improvement"


def test_stop_at_last_iteration(spark):
    r = last(spark, {"primary": 0.60}, {"primary": 0.66}, {"primary": 0.701})
    assert r["action"] == "STOP_MAX_ITERATIONS"


def test_improving_on_the_previous_attempt_breaks_the_streak(spark):
    rows = decide(spark, {"primary": 0.60}, {"primary": 0.66}, max_iterations=9)
    assert [r["action"] for r in rows] == ["RETRY", "RETRY"]


def test_invalid_twice(spark):
    rows = decide(spark, {"valid": False}, {"valid": False})
    assert [r["action"] for r in rows] == ["RETRY", "STOP_INVALID_STRATEGIES"]
    mixed = decide(spark, {"valid": False}, {}, {"valid": False}, max_iterations=9)
    assert mixed[2]["action"] == "RETRY"


def test_invalid_or_failed_last_attempt_stops(spark):
    assert last(spark, {}, {}, {"valid": False})["action"] == "STOP_MAX_ITERATIONS"
    failed = last(spark, {}, {}, {"status": "recoverable_error"})
    assert failed["action"] == "STOP_MAX_ITERATIONS"


def test_errors(spark):
    assert last(spark, {"status": "fatal_error"})["action"] == "STOP_EXECUTION_ERROR"
    twice = decide(spark, {"status": "recoverable_error"}, {"status": "recoverable_error"})
    assert [r["action"] for r in twice] == ["RETRY", "STOP_EXECUTION_ERROR"]


def test_failed_model(spark):
    r = last(spark, {"primary": 0.75, "failed": ["m2"]})
    assert (r["action"], r["reason_code"]) == ("RETRY", "model_evaluation_failure")
    assert r["primary_delta"] is None
    free = last(spark, {"primary": 0.75, "failed": ["m2"]}, require_all_models_successful=False)
    assert free["action"] == "ACCEPT"


def test_missing_metrics(spark):
    r = last(spark, {"failed": ["m1", "m2"]}, require_all_models_successful=False)
    assert r["reason_code"] == "missing_metrics"


def test_other_models_fail_the_query(spark):
    with pytest.raises(Exception, match="same models"):
        decide(spark, {"models": ("m1",)})


def test_invalid_attempt_may_lack_models(spark):
    assert last(spark, {"valid": False, "models": ()})["reason_code"] == "invalid_strategy"


def test_free_baseline_has_no_multiplier(spark):
    c, o = history(spark, {"primary": 0.75})
    from pyspark.sql import functions as F

    o = o.withColumn("fit_seconds", F.when(F.col("iteration") == 0, 0.0).otherwise(9.0))
    r = gt.gate_candidates(c, o).first()
    assert r["action"] == "ACCEPT" and r["runtime_multiplier"] is None


def test_selection(spark):
    rows = gt.gate_candidates(*history(spark, {"primary": 0.60}, {"primary": 0.69}, {"primary": 0.65}))
    assert gt.select_plan(rows).first()["plan_id"] == "p2"
    rows = gt.gate_candidates(*history(spark, {"primary": 0.90, "recall": 0.1}, {"primary": 0.72}))
    assert gt.select_plan(rows).first()["plan_id"] == "p2"
    best = gt.best_so_far(rows).orderBy("iteration").collect()
    assert [r["best_plan_id"] for r in best] == [None, "p2"]
    none = gt.gate_candidates(*history(spark, {"valid": False}))
    assert gt.select_plan(none).isEmpty()


def test_history_violations(spark):
    df = spark.createDataFrame(
        [("a", 1, "RETRY", "d"), ("a", 2, "ACCEPT", "d"), ("a", 3, "RETRY", "d"),
         ("b", 2, "RETRY", "d"), ("b", 3, "RETRY", "e")],
        "run_id string, iteration int, action string, dataset_id string",
    )
    found = {tuple(r) for r in gt.history_violations(df).collect()}
    assert found == {("a", 3, "after_terminal_decision"), ("b", 2, "not_sequential"),
                     ("b", 3, "dataset_changed")}


def test_history_that_contradicts_itself(spark):
    columns = ("run_id string, iteration int, action string, max_iterations int, plan_iteration int, "
               "assessment_iteration int, feedback_iteration int, plan_id string, feedback_plan_id string, "
               "is_new_best boolean, mean_primary double")
    good = ["a", 1, "RETRY", 2, 1, 1, 1, "p", "p", True, 0.5]
    changes = {
        "plan_iteration_differs": (4, 2), "assessment_iteration_differs": (5, None),
        "feedback_iteration_differs": (6, 0), "feedback_plan_differs": (8, None), "best_without_metric": (10, None),
    }
    rows = [tuple([name, *good[1:]][:i] + [v] + good[i + 1 :]) for name, (i, v) in changes.items()]
    rows += [tuple(good), ("late", 1, "RETRY", 1, 1, 1, 1, "p", "p", False, None), ("late", 2, "RETRY", 1, 2, 2, 2, "q", "q", None, None)]
    found = {tuple(r) for r in gt.history_violations(spark.createDataFrame(rows, columns)).collect()}
    assert found == {(name, 1, name) for name in changes} | {("late", 2, "over_maximum")}


def test_doubled_models_are_refused(spark):
    with pytest.raises(Exception, match="different ones"):
        decide(spark, {"models": ("m1", "m2", "m2")})


def test_attempts_without_evaluation_go_through_the_gate(spark):
    verdicts = spark.createDataFrame(
        [("r", 1, "p1", False, None), ("r", 2, "p2", True, "recoverable_error"), ("r", 3, "p3", True, None)],
        "run_id string, iteration int, plan_id string, is_valid boolean, error string")
    candidates, outcomes = history(spark)
    rows = gt.gate_candidates(candidates.unionByName(gt.unevaluated_attempts(verdicts)), outcomes, gt.GatePolicy())
    assert [(r["iteration"], r["reason_code"]) for r in rows.orderBy("iteration").collect()] == [
        (1, "invalid_strategy"), (2, "execution_error")]


def test_costs_of_the_selected_plan(spark):
    candidates, outcomes = history(spark, {"primary": 0.72, "quality": 0.95, "seconds": 3.0})
    evidence = gt.attempt_evidence(candidates, outcomes, gt.GatePolicy(maximum_runtime_multiplier=9))
    selected = gt.select_plan(gt.gate_candidates(candidates, outcomes, gt.GatePolicy(maximum_runtime_multiplier=9)))
    r = gt.selected_costs(candidates, evidence, selected).first()
    assert (r["plan_id"], r["initial_data_quality_score"], r["selected_data_quality_score"]) == ("p1", 0.90, 0.95)
    assert r["selected_runtime_multiplier"] == 3.0


def test_policy_is_checked():
    for bad in ({"max_iterations": 0}, {"maximum_recall_drop": 2}, {"maximum_runtime_multiplier": 0.5},
                {"minimum_primary_improvement": -1}):
        with pytest.raises(ValueError):
            gt.GatePolicy(**bad)
