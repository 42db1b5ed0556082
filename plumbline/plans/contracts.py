"""What a transformation plan may contain."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names that occur in plans.
KINDS = ("numeric", "categorical", "binary", "target")
ROLES = ("development", "training_fold", "validation_fold", "temporal_test")
MODELS = ("logistic_regression", "decision_tree", "random_forest")
SCOPES = ("all", *MODELS)
PLAN_FIELDS = ("plan_id", "dataset_id", "iteration", "objective", "actions")
ACTION_FIELDS = (
    "action_id", "transformation", "columns", "parameters", "rationale", "model_scope",
)
IDENTIFIER = r"\A[A-Za-z0-9_-]+\z"
TRANSFORMATION_NAME = r"\A[a-z][a-z0-9_]*\z"
SAMPLERS = ("random_undersampling", "random_oversampling", "smote")

PLAN_DDL = (
    "plan_id string, dataset_id string, iteration double, objective string, "
    "actions array<struct<action_id string, transformation string, columns array<string>, "
    "parameters map<string,variant>, rationale string, model_scope string>>"
)


@dataclass(frozen=True)
class Contract:
    """Column kinds and parameters of one transformation; no kinds means no columns."""

    kinds: tuple[str, ...] = ()
    parameters: tuple[str, ...] = ()
    choices: dict[str, tuple[str, ...]] = field(default_factory=dict)


# The seven transformations.
CONTRACTS = {
    "impute_numeric": Contract(
        ("numeric",), ("strategy",), {"strategy": ("median", "mean")}
    ),
    "impute_categorical": Contract(
        ("categorical",),
        ("strategy", "fill_value"),
        {"strategy": ("most_frequent", "constant")},
    ),
    "scale_numeric": Contract(("numeric",), ("method",), {"method": ("standard", "robust")}),
    "log_transform": Contract(("numeric",)),
    "one_hot_encode": Contract(("categorical",), ("handle_unknown",)),
    "class_weight": Contract((), ("mode",), {"mode": ("balanced",)}),
    "resample_classes": Contract((), ("method", "random_seed"), {"method": SAMPLERS}),
}
