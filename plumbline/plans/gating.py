"""Decide over the history of candidate plans, for many runs at once.

``candidates(run_id, iteration, plan_id, validation_valid, execution_status,
data_quality_score, preprocessing_seconds)`` and ``outcomes(run_id, iteration, model, status,
primary_metric, recall, precision, fit_seconds, predict_seconds)``. Iteration 0 of a run is the
baseline it is compared with; attempts count from 1 and a run has few of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCEPT = "ACCEPT"
RETRY = "RETRY"
STOP_NO_IMPROVEMENT = "STOP_NO_IMPROVEMENT"
STOP_MAX_ITERATIONS = "STOP_MAX_ITERATIONS"
STOP_INVALID_STRATEGIES = "STOP_INVALID_STRATEGIES"
STOP_EXECUTION_ERROR = "STOP_EXECUTION_ERROR"


@dataclass(frozen=True)
class GatePolicy:
    """Thresholds of the decision ladder."""

    # Names and defaults of the policy.
    max_iterations: int = 3
    no_improvement_patience: int = 2
    max_invalid_strategies: int = 2
    max_execution_errors: int = 2
    minimum_primary_improvement: float = 0.005
    minimum_quality_improvement: float = 0.0001
    maximum_recall_drop: float = 0.02
    maximum_precision_drop: float = 0.02
    maximum_runtime_multiplier: float = 3.0
    require_all_models_successful: bool = True

    def __post_init__(self) -> None:
        counts = (
            self.max_iterations,
            self.no_improvement_patience,
            self.max_invalid_strategies,
            self.max_execution_errors,
        )
        if min(counts) < 1:
            raise ValueError("Limits of the gate policy must be at least 1")
        if min(self.minimum_primary_improvement, self.minimum_quality_improvement) < 0:
            raise ValueError("Improvements of the gate policy cannot be negative")
        if not all(
            0 <= d <= 1 for d in (self.maximum_recall_drop, self.maximum_precision_drop)
        ):
            raise ValueError("Drops of the gate policy must lie between 0 and 1")
        if self.maximum_runtime_multiplier < 1:
            raise ValueError("The runtime multiplier cannot be below 1")


def attempt_evidence(candidates: DataFrame, outcomes: DataFrame, policy: GatePolicy) -> DataFrame:
    """One row per attempt with its means, costs, differences and guardrail violations."""
    ok = F.col("status") == "success"
    seconds = F.col("fit_seconds") + F.col("predict_seconds")
    reference = outcomes.where(F.col("iteration") == 0).select(
        "run_id",
        "model",
        ok.alias("r_ok"),
        F.col("recall").alias("r_recall"),
        F.col("precision").alias("r_precision"),
    )
    both = ok & F.col("r_ok")

    def dropped(metric: str, limit: float) -> Column:
        return F.when(
            both & (F.col(f"r_{metric}") - F.col(metric) > limit),
            F.concat(F.lit(f"{metric}:"), F.col("model")),
        )

    violated = F.array_compact(
        F.array(
            dropped("recall", policy.maximum_recall_drop),
            dropped("precision", policy.maximum_precision_drop),
        )
    )

    # A model counted twice would weigh twice in means and seconds.
    doubled = F.count("model") != F.size(F.collect_set("model"))
    refused = F.raise_error(F.lit("The models of an attempt must be different ones")).cast("double")

    def totals(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.groupBy("run_id", "iteration").agg(
            F.when(doubled, refused).otherwise(F.avg(F.when(ok, F.col("primary_metric")))).alias("mean_primary"),
            F.sum(seconds).alias("model_seconds"),
            F.array_sort(F.collect_set("model")).alias("models"),
            *more,
        )

    attempts = totals(
        outcomes.where(F.col("iteration") > 0).join(reference, ["run_id", "model"], "left"),
        F.bool_or(~ok).alias("any_failed"),
        F.array_sort(F.flatten(F.collect_list(violated))).alias("violations"),
    )
    cost = F.col("preprocessing_seconds") + F.coalesce("model_seconds", F.lit(0.0))
    base = (
        candidates.where(F.col("iteration") == 0)
        .join(totals(outcomes.where(F.col("iteration") == 0)), ["run_id", "iteration"], "left")
        .select(
            "run_id",
            F.col("mean_primary").alias("b_primary"),
            F.col("data_quality_score").alias("b_quality"),
            cost.alias("b_seconds"),
            F.col("models").alias("b_models"),
        )
    )
    none = F.array().cast("array<string>")
    return (
        candidates.where(F.col("iteration") > 0)
        .join(attempts, ["run_id", "iteration"], "left")
        .join(base, "run_id", "left")
        .withColumns(
            {
                "total_seconds": cost,
                "any_failed": F.coalesce("any_failed", F.lit(False)),
                "violations": F.coalesce("violations", none),
                "same_models": F.coalesce("models", none) == F.coalesce("b_models", none),
            }
        )
        .withColumns(
            {
                "primary_delta": F.col("mean_primary") - F.col("b_primary"),
                "quality_delta": F.col("data_quality_score") - F.col("b_quality"),
                "runtime_multiplier": F.col("total_seconds") / F.nullif("b_seconds", F.lit(0.0)),
            }
        )
        .drop("b_models", "models", "model_seconds")
    )


def _streaks(evidence: DataFrame, policy: GatePolicy) -> DataFrame:
    """Add how many attempts in a row were invalid, failed or without improvement."""
    order = W.partitionBy("run_id").orderBy("iteration")
    place = F.row_number().over(order)
    previous = F.lag("mean_primary").over(order)
    improved = F.coalesce(
        F.col("mean_primary") - previous >= policy.minimum_primary_improvement, F.lit(False)
    ) & (place > 1)
    rows = evidence.withColumns({"_place": place, "_improved": improved})
    executed = F.col("execution_status") == "success"
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)

    def since(breaks: Column) -> Column:
        last = F.max(F.when(breaks, F.col("_place"))).over(upto)
        return F.col("_place") - F.coalesce(last, F.lit(0))

    return rows.withColumns(
        {
            "invalid_streak": since(F.col("validation_valid")),
            "error_streak": since(executed),
            "idle_streak": since(
                ~F.col("validation_valid") | ~executed | F.col("_improved")
            ),
        }
    ).drop("_place", "_improved")


def gate_candidates(
    candidates: DataFrame, outcomes: DataFrame, policy: GatePolicy = GatePolicy()
) -> DataFrame:
    """Decision of every attempt: the first rule of the ladder that applies.

    An invalid or failed attempt that would be retried after the last iteration stops the run
    instead. A run whose models differ from its baseline's fails the query.
    """
    rows = _streaks(attempt_evidence(candidates, outcomes, policy), policy)
    valid = F.col("validation_valid")
    executed = F.col("execution_status") == "success"
    last = F.col("iteration") >= policy.max_iterations
    failed_model = F.lit(policy.require_all_models_successful) & F.col("any_failed")
    no_metric = F.col("mean_primary").isNull() | F.col("b_primary").isNull()
    violated = F.size("violations") > 0
    costly = F.coalesce(
        F.col("runtime_multiplier") > policy.maximum_runtime_multiplier, F.lit(False)
    )
    gained = F.col("primary_delta") >= policy.minimum_primary_improvement
    cleaner = F.coalesce(
        (F.col("quality_delta") >= policy.minimum_quality_improvement)
        & (F.col("primary_delta") >= 0),
        F.lit(False),
    )
    mismatch = F.raise_error(F.lit("Attempt and baseline must cover the same models"))
    reason = (
        F.when(~valid, "invalid_strategy")
        .when(~executed, "execution_error")
        .when(~F.col("same_models"), mismatch.cast("string"))
        .when(failed_model, "model_evaluation_failure")
        .when(no_metric, "missing_metrics")
        .when(violated, "metric_guardrail_violation")
        .when(costly, "excessive_runtime_cost")
        .when(gained | cleaner, "improvement_accepted")
        .otherwise("insufficient_improvement")
    )
    again = F.when(last, STOP_MAX_ITERATIONS).otherwise(RETRY)
    fatal = (F.col("execution_status") == "fatal_error") | (
        F.col("error_streak") >= policy.max_execution_errors
    )
    why = F.col("reason_code")
    action = (
        F.when(
            why == "invalid_strategy",
            F.when(
                F.col("invalid_streak") >= policy.max_invalid_strategies, STOP_INVALID_STRATEGIES
            ).otherwise(again),
        )
        .when(why == "execution_error", F.when(fatal, STOP_EXECUTION_ERROR).otherwise(again))
        .when(why == "improvement_accepted", ACCEPT)
        .when(last, STOP_MAX_ITERATIONS)
        .when(
            F.col("idle_streak") >= policy.no_improvement_patience, STOP_NO_IMPROVEMENT
        )
        .otherwise(RETRY)
    )
    compared = why.isin(
        "metric_guardrail_violation",
        "excessive_runtime_cost",
        "improvement_accepted",
        "insufficient_improvement",
    )
    return (
        rows.withColumn("reason_code", reason)
        .withColumn("action", action)
        .select(
            "run_id",
            "iteration",
            "plan_id",
            "validation_valid",
            "action",
            "reason_code",
            F.when(compared, F.col("primary_delta")).alias("primary_delta"),
            F.when(compared, F.col("quality_delta")).alias("quality_delta"),
            F.when(compared, F.col("runtime_multiplier")).alias("runtime_multiplier"),
            F.when(compared, F.col("violations"))
            .otherwise(F.array().cast("array<string>"))
            .alias("violations"),
            "mean_primary",
            (F.col("action") == ACCEPT).alias("is_new_best"),
        )
    )


def select_plan(decisions: DataFrame) -> DataFrame:
    """Per run the last accepted attempt, else the valid one with the best primary metric."""
    accepted = F.col("action") == ACCEPT
    usable = accepted | (F.col("validation_valid") & F.col("mean_primary").isNotNull())
    preference = F.struct(
        F.when(accepted, F.col("iteration")).otherwise(0),
        F.when(accepted, 0.0).otherwise(F.col("mean_primary")),
        -F.col("iteration"),
    )
    chosen = F.max_by(F.struct("iteration", "plan_id", "action", "mean_primary"), preference)
    return (
        decisions.where(usable)
        .groupBy("run_id")
        .agg(chosen.alias("chosen"))
        .select("run_id", "chosen.*")
    )


def unevaluated_attempts(verdicts: DataFrame) -> DataFrame:
    """``candidates`` rows of attempts without an evaluation, as the gate expects them.

    Needs ``run_id, iteration, plan_id, is_valid`` and ``error``: null, "recoverable_error" or
    "fatal_error". Refused plans and failed executions have no quality and took no time.
    """
    return verdicts.where(~F.col("is_valid") | F.col("error").isNotNull()).select(
        "run_id",
        "iteration",
        "plan_id",
        F.col("is_valid").alias("validation_valid"),
        F.coalesce("error", F.lit("success")).alias("execution_status"),
        F.lit(None).cast("double").alias("data_quality_score"),
        F.lit(0.0).alias("preprocessing_seconds"),
    )


def selected_costs(candidates: DataFrame, evidence: DataFrame, selected: DataFrame) -> DataFrame:
    """Per run the quality before and after the selected plan, and its runtime against the baseline's.

    ``evidence`` is that of ``attempt_evidence`` and ``selected`` the rows of ``select_plan``.
    """
    first = candidates.where(F.col("iteration") == 0).select(
        "run_id", F.col("data_quality_score").alias("initial_data_quality_score")
    )
    chosen = evidence.join(selected.select("run_id", "iteration"), ["run_id", "iteration"])
    return chosen.join(first, "run_id").select(
        "run_id",
        "plan_id",
        "initial_data_quality_score",
        F.col("data_quality_score").alias("selected_data_quality_score"),
        F.col("quality_delta").alias("selected_quality_delta"),
        F.col("runtime_multiplier").alias("selected_runtime_multiplier"),
    )


def history_violations(history: DataFrame) -> DataFrame:
    """``(run_id, iteration, violation)`` of attempts that break the order of a run or contradict themselves.

    Needs ``run_id, iteration, action``. Further checks come with their columns: ``dataset_id`` (the
    same in a run), ``max_iterations`` (not exceeded), ``plan_iteration``, ``assessment_iteration`` and
    ``feedback_iteration`` (equal to the attempt's), ``feedback_plan_id`` (equal to ``plan_id``), and
    ``is_new_best`` (only with ``mean_primary``).
    """
    order = W.partitionBy("run_id").orderBy("iteration")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    expected = F.coalesce(F.lag("iteration").over(order), F.lit(0)) + 1

    def differs(a: str, b: str) -> Column:
        return ~F.col(a).eqNullSafe(F.col(b))

    checks = {
        "not_sequential": ((), F.col("iteration") != expected),
        "after_terminal_decision": (
            (),
            F.coalesce(F.bool_or(F.col("action") != RETRY).over(earlier), F.lit(False)),
        ),
        "over_maximum": (("max_iterations",), F.coalesce(F.expr("iteration > max_iterations"), F.lit(False))),
        "dataset_changed": (
            ("dataset_id",),
            F.coalesce(F.expr("dataset_id") != F.first(F.expr("dataset_id")).over(earlier), F.lit(False)),
        ),
        "plan_iteration_differs": (("plan_iteration",), differs("plan_iteration", "iteration")),
        "assessment_iteration_differs": (("assessment_iteration",), differs("assessment_iteration", "iteration")),
        "feedback_iteration_differs": (("feedback_iteration",), differs("feedback_iteration", "iteration")),
        "feedback_plan_differs": (("feedback_plan_id", "plan_id"), differs("feedback_plan_id", "plan_id")),
        "best_without_metric": (
            ("is_new_best", "mean_primary"),
            F.coalesce(F.expr("is_new_best AND mean_primary IS NULL"), F.lit(False)),
        ),
    }
    given = set(history.columns)
    checks = {n: c for n, (needs, c) in checks.items() if given.issuperset(needs)}
    flagged = history.withColumns({f"_{n}": c for n, c in checks.items()})
    names = F.array_compact(
        F.array(*[F.when(F.col(f"_{n}"), F.lit(n)) for n in checks])
    )
    return flagged.select("run_id", "iteration", F.explode(names).alias("violation"))


def best_so_far(decisions: DataFrame) -> DataFrame:
    """Add the plan, iteration and metric that led after each attempt."""
    upto = W.partitionBy("run_id").orderBy("iteration").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )

    def leader(c: str) -> Column:
        return F.last(F.when(F.col("is_new_best"), F.col(c)), ignorenulls=True).over(upto)

    return decisions.select(
        "run_id",
        "iteration",
        "action",
        leader("plan_id").alias("best_plan_id"),
        leader("iteration").alias("best_iteration"),
        leader("mean_primary").alias("best_primary_metric"),
    )
