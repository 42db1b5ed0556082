"""MLlib classifiers with the settings used for comparison."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)

from plumbline.plans.contracts import MODELS

# Default settings. Trees stop at MLlib's depth limit of 30.
DEFAULTS: dict[str, dict[str, Any]] = {
    "logistic_regression": {"max_iter": 1000, "c": 1.0},
    "decision_tree": {"min_leaf": 2, "max_depth": 30, "max_bins": 64},
    "random_forest": {"trees": 100, "min_leaf": 2, "max_depth": 20, "max_bins": 64},
}
# MLlib draws bootstraps of rows; weights are those of the whole training set.


def create_estimator(
    model: str,
    total_weight: float,
    seed: int = 42,
    settings: Mapping[str, Any] | None = None,
    weight: str | None = "weight",
) -> Estimator:
    """Untrained classifier on ``features`` and ``label``.

    Deep trees keep the node each row has reached, checkpointed at intervals, instead of going down
    from the root again. ``total_weight`` is the sum of the training weights. MLlib averages the loss over it, so
    the L2 strength 1 / C of a summed loss becomes 1 / (C * total_weight).
    """
    if model not in MODELS:
        raise ValueError(f"Unsupported model '{model}'; known are {', '.join(MODELS)}")
    s = {**DEFAULTS[model], **(settings or {})}
    if model == "logistic_regression":
        made = LogisticRegression(
            maxIter=s["max_iter"],
            regParam=1.0 / (s["c"] * total_weight),
            elasticNetParam=0.0,
            standardization=False,
        )
    elif model == "decision_tree":
        made = DecisionTreeClassifier(
            maxDepth=s["max_depth"],
            minInstancesPerNode=s["min_leaf"],
            maxBins=s["max_bins"],
            cacheNodeIds=True,
            seed=seed,
        )
    else:
        made = RandomForestClassifier(
            numTrees=s["trees"],
            maxDepth=s["max_depth"],
            minInstancesPerNode=s["min_leaf"],
            maxBins=s["max_bins"],
            cacheNodeIds=True,
            seed=seed,
        )
    return made.setWeightCol(weight) if weight else made
