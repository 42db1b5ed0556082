"""Learn a plan on training rows and apply it to any rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import nan_to_null, to_number
from plumbline.operators import transforms as t
from plumbline.operators.categories import learn_one_hot, vector_encoder, with_indices
from plumbline.operators.neighbours import smote
from plumbline.operators.quality import WEIGHTS, quality_of
from plumbline.operators.sampling import oversample, undersample
from plumbline.plans.contracts import SCOPES

FORBIDDEN_ROLES = ("validation_fold", "temporal_test")


@dataclass(frozen=True)
class Action:
    action_id: str
    transformation: str
    columns: tuple[str, ...] = ()
    parameters: Mapping[str, Any] = field(default_factory=dict)
    model_scope: str = "all"


@dataclass(frozen=True)
class Plan:
    plan_id: str
    dataset_id: str
    iteration: int
    actions: tuple[Action, ...]


def read_plan(text: str) -> Plan:
    """One plan from JSON whose shape ``parse_plans`` found in order."""
    body = json.loads(text)
    actions = tuple(
        Action(
            a["action_id"],
            a["transformation"],
            tuple(a.get("columns") or ()),
            dict(a.get("parameters") or {}),
            a.get("model_scope") or "all",
        )
        for a in body.get("actions", ())
    )
    return Plan(body["plan_id"], body["dataset_id"], int(body["iteration"]), actions)


Apply = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Facts:
    """What actions learn, known before for columns that no earlier action changed.

    Quantiles by column and probability, moments (mean, spread), modes, and the table of categories
    with its sizes and the columns that have a missing one. What isn't there is learned by a job.
    """

    quantiles: Mapping[str, Mapping[float, float]] = field(default_factory=dict)
    moments: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    modes: Mapping[str, str] = field(default_factory=dict)
    categories: DataFrame | None = None
    sizes: Mapping[str, int] = field(default_factory=dict)
    missing: frozenset[str] = frozenset()
    # Encoders by their sizes, shared by all that learn from the same categories.
    encoders: dict[tuple, Apply] = field(default_factory=dict)

    def filled(self, columns: Iterable[str]) -> Facts:
        """The same after the columns were filled with one of their categories."""
        gone = self.missing & set(columns)
        if not gone:
            return self
        own = F.col("column").isin(*gone)
        # A missing category has the index 0.
        rest = self.categories.where(~own | F.col("value").isNotNull()).withColumn(
            "index", F.col("index") - F.when(own, 1).otherwise(0)
        )
        sizes = {c: n - (c in gone) for c, n in self.sizes.items()}
        return replace(self, categories=rest, sizes=sizes, missing=self.missing - gone)


Learn = Callable[[DataFrame, Sequence[str], Mapping[str, Any], Facts], Apply]


def _known(facts: Mapping[str, Any], columns: Sequence[str]) -> dict[str, Any] | None:
    return {c: facts[c] for c in columns} if all(c in facts for c in columns) else None


def _learn_impute_numeric(train, columns, parameters, facts) -> Apply:
    strategy = parameters["strategy"]
    if strategy == "median" and (known := _known(facts.quantiles, columns)) is not None:
        fills = {c: q.get(0.5) for c, q in known.items()}
    elif strategy == "mean" and (known := _known(facts.moments, columns)) is not None:
        fills = {c: m for c, (m, _) in known.items()}
    else:
        fills = t.learn_fill(train, columns, strategy)
    return lambda df: t.fill_numbers(df, fills)


def _learn_impute_categorical(train, columns, parameters, facts) -> Apply:
    strategy, known = parameters["strategy"], _known(facts.modes, columns)
    if strategy != "most_frequent" or known is None:
        known = t.learn_values(train, columns, strategy, parameters.get("fill_value"))
    return lambda df: t.fill_values(df, known)


def _learn_scale(train, columns, parameters, facts) -> Apply:
    method = parameters["method"]
    if method == "standard" and (known := _known(facts.moments, columns)) is not None:
        scales = {c: (m, t.unit_if_zero(s)) for c, (m, s) in known.items()}
    elif method == "robust" and (known := _known(facts.quantiles, columns)) is not None:
        scales = {c: (q[0.5], t.unit_if_zero(q[0.75] - q[0.25])) if q else (None, None) for c, q in known.items()}
    else:
        scales = t.learn_scale(train, columns, method)
    return lambda df: t.rescale(df, scales)


def _learn_log(train, columns, parameters, facts) -> Apply:
    return lambda df: t.log_transform(df, columns)


def _learn_one_hot(train, columns, parameters, facts) -> Apply:
    categories = t.learn_categories(train, columns)
    return lambda df: t.encode(df, categories)


def _learn_sparse_one_hot(train, columns, parameters, facts) -> Apply:
    if facts.categories is None or _known(facts.sizes, columns) is None:
        return learn_one_hot(train, columns)
    sizes = {c: facts.sizes[c] for c in columns}
    categories = facts.categories.where(F.col("column").isin(*columns))
    known = tuple(sizes.items())
    if known not in facts.encoders:
        facts.encoders[known] = vector_encoder(train.sparkSession, sizes)
    as_vectors = facts.encoders[known]
    return lambda df: as_vectors(with_indices(df, categories, sizes))


LEARNERS: dict[str, Learn] = {
    "impute_numeric": _learn_impute_numeric,
    "impute_categorical": _learn_impute_categorical,
    "scale_numeric": _learn_scale,
    "log_transform": _learn_log,
    "one_hot_encode": _learn_one_hot,
}
# For training: categories as positions of one vector, however many there are.
SPARSE_LEARNERS: dict[str, Learn] = {**LEARNERS, "one_hot_encode": _learn_sparse_one_hot}


@dataclass(frozen=True)
class LearnedPlan:
    """Steps learned for one model, its optional sampler and class weighting."""

    steps: tuple[Apply, ...]
    applied: tuple[Action, ...]
    sampler: Action | None
    class_weight: bool

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df

    def resample(self, train: DataFrame, target: str, key: Sequence[str]) -> DataFrame:
        """Balance transformed training rows; validation rows never pass here."""
        if self.sampler is None:
            return train
        method = self.sampler.parameters["method"]
        seed = self.sampler.parameters["random_seed"]
        if method == "random_undersampling":
            return undersample(train, target, key, seed)
        if method == "random_oversampling":
            return oversample(train, target, key, seed)
        if method == "smote":
            return smote(train, target, key, seed=seed)
        raise ValueError(f"Unknown sampling method: {method}")


def check_role(plan: Plan, dataset_id: str, role: str) -> None:
    if plan.dataset_id != dataset_id:
        raise ValueError("The plan was made for another dataset")
    if role in FORBIDDEN_ROLES:
        raise ValueError(f"Learning a plan is forbidden on the role '{role}'")


def actions_for(plan: Plan, model: str) -> tuple[Action, ...]:
    for action in plan.actions:
        if action.model_scope not in SCOPES:
            raise ValueError(f"Unknown model scope: {action.model_scope}")
    return tuple(a for a in plan.actions if a.model_scope in ("all", model))


def learn_plan(
    train: DataFrame,
    plan: Plan,
    model: str,
    dataset_id: str | None = None,
    role: str = "training_fold",
    learners: Mapping[str, Learn] = LEARNERS,
    facts: Facts | None = None,
) -> LearnedPlan:
    """Learn the actions in order, each on the training rows as the earlier ones left them.

    What actions need of columns that are as they were is learned together, or passed as ``facts``.
    """
    check_role(plan, plan.dataset_id if dataset_id is None else dataset_id, role)
    steps: list[Apply] = []
    applied = actions_for(plan, model)
    sampler, class_weight = None, False
    changes = _Changes()
    if facts is None:
        facts = facts_of(train, plan, model)
    for action in applied:
        if action.transformation == "resample_classes":
            if sampler is not None:
                raise ValueError("A plan may hold one class sampler per model")
            sampler = action
        elif action.transformation == "class_weight":
            class_weight = action.parameters["mode"] == "balanced"
        elif action.transformation in learners:
            known = facts.filled(changes.filled) if changes.known(action) else Facts()
            step = learners[action.transformation](train, action.columns, action.parameters, known)
            train = step(train)
            steps.append(step)
            changes.add(action)
        else:
            raise ValueError(f"No transformation is registered as '{action.transformation}'")
    return LearnedPlan(tuple(steps), applied, sampler, class_weight)


class _Changes:
    """Columns that the actions so far changed, and those that were only filled with their mode."""

    def __init__(self) -> None:
        self.changed: set[str] = set()
        self.filled: set[str] = set()

    def known(self, action: Action) -> bool:
        """Whether facts of the raw columns do for an action."""
        own = set(action.columns)
        if action.transformation == "one_hot_encode":
            own -= self.filled
        return self.changed.isdisjoint(own)

    def add(self, action: Action) -> None:
        own = set(action.columns)
        mode = action.transformation == "impute_categorical" and action.parameters.get("strategy") == "most_frequent"
        self.filled = (self.filled | (own - self.changed)) if mode else self.filled - own
        self.changed |= own


# What is to be known for an action, by its strategy or method.
_FACTS = {
    ("impute_numeric", "median"): "quantiles",
    ("impute_numeric", "mean"): "moments",
    ("impute_categorical", "most_frequent"): "modes",
    ("scale_numeric", "robust"): "quantiles",
    ("scale_numeric", "standard"): "moments",
    ("one_hot_encode", None): "categories",
}


def facts_wanted(plan: Plan, models: Sequence[str]) -> dict[str, list[str]]:
    """Columns by what the plan's actions can use of them as they come, before any action."""
    wanted: dict[str, dict[str, None]] = {k: {} for k in _FACTS.values()}
    for model in models:
        changes = _Changes()
        for action in actions_for(plan, model):
            how = action.parameters.get("strategy") or action.parameters.get("method")
            kind = _FACTS.get((action.transformation, how))
            if kind and changes.known(action):
                wanted[kind].update(dict.fromkeys(action.columns))
            if action.transformation in LEARNERS:
                changes.add(action)
    return {k: list(v) for k, v in wanted.items()}


def facts_of(train: DataFrame, plan: Plan, model: str) -> Facts:
    """What the plan's actions learn from columns as they come: one job per kind, not per action."""
    wanted = facts_wanted(plan, [model])
    return Facts(
        t.learn_quantiles(train, wanted["quantiles"], [0.25, 0.5, 0.75]) if wanted["quantiles"] else {},
        t.learn_moments(train, wanted["moments"]) if wanted["moments"] else {},
        t.learn_modes(train, wanted["modes"]) if wanted["modes"] else {},
    )


def apply_plan(
    df: DataFrame, plan: Plan, model: str, train: DataFrame | None = None, **context: str
) -> DataFrame:
    return learn_plan(df if train is None else train, plan, model, **context).transform(df)


def applied_actions(df: DataFrame, learned: LearnedPlan) -> DataFrame:
    """Audit rows ``(position, action_id, transformation, columns, model_scope)``."""
    rows = [
        (i, a.action_id, a.transformation, list(a.columns), a.model_scope)
        for i, a in enumerate(learned.applied)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "position int, action_id string, transformation string, columns array<string>, "
        "model_scope string",
    )


def repair_missing(df: DataFrame, actions: Iterable[Action]) -> DataFrame:
    """Apply the imputations of a plan; everything else leaves data quality as it is."""
    df = nan_to_null(df)
    for action in actions:
        if action.transformation == "impute_numeric":
            for c in action.columns:
                df = df.withColumn(c, to_number(c))
            df = t.impute_numeric(df, action.columns, action.parameters["strategy"])
        elif action.transformation == "impute_categorical":
            df = t.impute_categorical(
                df,
                action.columns,
                action.parameters["strategy"],
                action.parameters.get("fill_value"),
            )
    return df


def plan_quality(
    df: DataFrame,
    plan: Plan,
    role: str = "development",
    weights: Mapping[str, float] = WEIGHTS,
) -> DataFrame:
    """Quality before and after a plan, one row per ``stage``."""
    if role != "development":
        raise ValueError("Plan quality is measured on development data only")
    stages: dict[str, DataFrame] = {"before": df, "after": repair_missing(df, plan.actions)}
    parts = [
        quality_of(rows, (), weights).select(F.lit(stage).alias("stage"), "*")
        for stage, rows in stages.items()
    ]
    return parts[0].unionByName(parts[1])
