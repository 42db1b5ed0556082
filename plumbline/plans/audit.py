"""Check a table of parsed plans against a dataset, reporting all issues at once.

The catalogue of a dataset is as small as its schema, so it enters as one map value and the
whole audit is a single pass over the plans without a shuffle. Plans of several datasets are joined
with the map of their own one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import computed_once
from plumbline.plans.contracts import CONTRACTS, KINDS, ROLES

ISSUE_DDL = "struct<action_id:string,code:string,detail:string>"


def columns_catalog(
    df: DataFrame, kinds: dict[str, str], protected: Iterable[str] = (), dataset_id: str | None = None
) -> DataFrame:
    """``(column, kind, protected)`` of a table; the target is always protected.

    With ``dataset_id`` as a column in front, catalogues of several tables can be put together.
    """
    guarded = set(protected)
    unknown = sorted(set(kinds) - set(df.columns))
    if unknown:
        raise ValueError(f"Catalogued columns do not exist: {', '.join(unknown)}")
    odd = sorted(set(kinds.values()) - set(KINDS))
    if odd:
        raise ValueError(f"Unknown column kinds: {', '.join(odd)}")
    if list(kinds.values()).count("target") != 1:
        raise ValueError("Exactly one column must be the target")
    rows = [(c, k, c in guarded or k == "target") for c, k in kinds.items()]
    made = df.sparkSession.createDataFrame(rows, "column string, kind string, protected boolean")
    return made if dataset_id is None else made.select(F.lit(dataset_id).alias("dataset_id"), "*")


def _names(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _issue(condition: Column, action_id: Column, code: str, detail: Column | str) -> Column:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return F.when(
        condition,
        F.struct(
            action_id.cast("string").alias("action_id"),
            F.lit(code).alias("code"),
            text.cast("string").alias("detail"),
        ),
    )


def _each(names: Column, action_id: Column, code: str) -> Column:
    return F.transform(
        names,
        lambda n: F.struct(
            action_id.cast("string").alias("action_id"),
            F.lit(code).alias("code"),
            n.cast("string").alias("detail"),
        ),
    )


def _text(parameters: Column, name: str) -> Column:
    return parameters[name].cast("string")


def _parameter_issues(action: Column) -> Column:
    """Issues of parameters; conditions on the action's name keep it to one expression."""
    name, given, action_id = action["transformation"], action["parameters"], action["action_id"]
    checks = []
    for transformation, contract in CONTRACTS.items():
        this = name == transformation
        unknown = F.array_except(F.map_keys(given), _names(contract.parameters))
        checks.append(
            _issue(
                this & (F.size(unknown) > 0),
                action_id,
                "unknown_parameter",
                F.array_join(F.array_sort(unknown), ","),
            )
        )
        for parameter, choices in contract.choices.items():
            good = F.coalesce(_text(given, parameter).isin(*choices), F.lit(False))
            checks.append(_issue(this & ~good, action_id, "invalid_parameter", parameter))
    checks += [
        _issue(
            (name == "impute_categorical")
            & F.coalesce(_text(given, "strategy") == "constant", F.lit(False))
            & ~F.map_contains_key(given, F.lit("fill_value")),
            action_id,
            "missing_parameter",
            "fill_value",
        ),
        _issue(
            (name == "one_hot_encode")
            & F.map_contains_key(given, F.lit("handle_unknown"))
            & ~F.coalesce(_text(given, "handle_unknown") == "ignore", F.lit(False)),
            action_id,
            "unsafe_parameter",
            "handle_unknown",
        ),
        _issue(
            (name == "resample_classes")
            & ~F.coalesce(
                F.schema_of_variant(given["random_seed"]) == "BIGINT", F.lit(False)
            ),
            action_id,
            "invalid_parameter",
            "random_seed",
        ),
    ]
    return F.array_compact(F.array(*checks))


def _signature(action: Column) -> Column:
    """Text equal for actions that do the same; 42 and "42" differ."""
    typed = F.transform_values(
        action["parameters"],
        lambda _, v: F.concat_ws(":", F.schema_of_variant(v), v.cast("string")),
    )
    return F.to_json(
        F.struct(
            action["transformation"].alias("t"),
            action["columns"].alias("c"),
            action["model_scope"].alias("s"),
            F.array_sort(F.map_entries(typed)).alias("p"),
        )
    )


def with_issues(
    plans: DataFrame,
    catalog: DataFrame,
    dataset_id: str | Column,
    role: str | Column = "development",
    allowed: Iterable[str] | None = None,
    iteration: int | Column | None = None,
) -> DataFrame:
    """Add ``issues``, an array of ``(action_id, code, detail)``, to parsed plans.

    A plan made for another dataset, or another ``iteration`` than the one asked for, has an issue.
    Where the catalogue names datasets, columns are looked up in the plan's own; a dataset that it
    doesn't name has no columns.
    """
    permitted = sorted(CONTRACTS if allowed is None else set(allowed))
    unregistered = sorted(set(permitted) - set(CONTRACTS))
    if unregistered:
        raise ValueError(f"Allowed transformations are not known: {', '.join(unregistered)}")
    if isinstance(role, str) and role not in ROLES:
        raise ValueError(f"Unknown dataset role: {role}")
    role = role if isinstance(role, Column) else F.lit(role)
    dataset = dataset_id if isinstance(dataset_id, Column) else F.lit(dataset_id)
    entry = F.struct("column", F.struct("kind", "protected").alias("what"))
    columns = F.map_from_entries(F.collect_list(entry)).alias("_known")
    if "dataset_id" in catalog.columns:
        own = catalog.groupBy(F.col("dataset_id").alias("_dataset")).agg(columns)
        nothing = F.create_map().cast(own.schema["_known"].dataType)
        known = (
            plans.join(own, F.col("dataset_id") == F.col("_dataset"), "left")
            .drop("_dataset")
            .withColumn("_known", F.coalesce("_known", nothing))
        )
    else:
        known = plans.withColumn("_known", catalog.agg(columns).scalar())
    rows = computed_once(known, _signatures=F.transform("actions", _signature))
    catalogued = F.col("_known")
    kinds = F.create_map(
        *[x for t, c in CONTRACTS.items() for x in (F.lit(t), _names(c.kinds))]
    )
    with_columns = [t for t, c in CONTRACTS.items() if c.kinds]

    def action_issues(action: Column, position: Column) -> Column:
        action_id, columns = action["action_id"], action["columns"]
        name = action["transformation"]
        takes_columns = name.isin(*with_columns)
        signature = F.col("_signatures")[position]
        checks = F.concat(
            _each(
                F.filter(columns, lambda c: ~F.map_contains_key(catalogued, c)),
                action_id,
                "column_not_found",
            ),
            _each(
                F.filter(
                    columns, lambda c: F.coalesce(catalogued[c]["protected"], F.lit(False))
                ),
                action_id,
                "protected_column_reference",
            ),
            _each(
                F.filter(
                    columns,
                    lambda c: catalogued[c].isNotNull()
                    & ~F.array_contains(kinds[name], catalogued[c]["kind"]),
                ),
                action_id,
                "incompatible_column_type",
            ),
            F.array_compact(
                F.array(
                    _issue(
                        (name == "resample_classes") & (role == "validation_fold"),
                        action_id,
                        "sampling_outside_training_forbidden",
                        name,
                    ),
                    _issue(
                        takes_columns & (F.size(columns) == 0),
                        action_id,
                        "columns_required",
                        name,
                    ),
                    _issue(
                        ~takes_columns & (F.size(columns) > 0),
                        action_id,
                        "columns_not_allowed",
                        name,
                    ),
                    _issue(
                        F.array_position(F.col("_signatures"), signature) < position + 1,
                        action_id,
                        "duplicate_action",
                        name,
                    ),
                )
            ),
            _parameter_issues(action),
        )
        refused = F.array(
            _issue(F.lit(True), action_id, "transformation_not_allowed", name)
        )
        return F.when(name.isin(*permitted), checks).otherwise(refused)

    of_plan = F.array_compact(
        F.array(
            _issue(
                role == "temporal_test", F.lit(None), "temporal_test_access_forbidden", role
            ),
            _issue(
                F.col("dataset_id") != dataset,
                F.lit(None),
                "dataset_mismatch",
                F.col("dataset_id"),
            ),
            _issue(
                F.lit(False) if iteration is None else F.col("iteration") != iteration,
                F.lit(None),
                "iteration_mismatch",
                F.col("iteration"),
            ),
        )
    )
    issues = F.concat(of_plan, F.flatten(F.transform("actions", action_issues)))
    return computed_once(rows, issues=issues.cast(f"array<{ISSUE_DDL}>")).drop(
        "_known", "_signatures"
    )


def audit_plans(
    plans: DataFrame,
    catalog: DataFrame,
    dataset_id: str | Column,
    role: str | Column = "development",
    allowed: Iterable[str] | None = None,
    iteration: int | Column | None = None,
) -> DataFrame:
    """``(plan_id, action_id, code, detail)``, one row per issue."""
    return with_issues(plans, catalog, dataset_id, role, allowed, iteration).select(
        "plan_id", F.inline("issues")
    )


def plan_verdicts(
    plans: DataFrame,
    catalog: DataFrame,
    dataset_id: str | Column,
    role: str | Column = "development",
    allowed: Iterable[str] | None = None,
    iteration: int | Column | None = None,
) -> DataFrame:
    """``(plan_id, issue_count, is_valid)``."""
    return with_issues(plans, catalog, dataset_id, role, allowed, iteration).select(
        "plan_id",
        F.size("issues").alias("issue_count"),
        (F.size("issues") == 0).alias("is_valid"),
    )
