"""Parse a table of JSON plans and report every violation of their shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import col, computed_once, spread
from plumbline.plans.contracts import (
    ACTION_FIELDS,
    IDENTIFIER,
    PLAN_DDL,
    PLAN_FIELDS,
    SCOPES,
    TRANSFORMATION_NAME,
)


def _when(condition: Column, code: str, detail: Column | str) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(condition, F.struct(F.lit(code).alias("code"), text.alias("detail")))


def _each(values: Column, code: str) -> Column:
    return F.transform(
        values, lambda v: F.struct(F.lit(code).alias("code"), v.cast("string").alias("detail"))
    )


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _empty_list(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _unknown_keys(text: Column, allowed: Sequence[str]) -> Column:
    keys = F.coalesce(F.json_object_keys(text), _empty_list("string"))
    return _each(F.array_except(keys, _strings(allowed)), "unknown_field")


def _blank(value: Column) -> Column:
    return value.isNull() | (F.length(value) == 0)


def _mismatch(value: Column, pattern: str) -> Column:
    return ~F.coalesce(value.rlike(pattern), F.lit(False))


def _kind(document: Column, field: str) -> Column:
    """The JSON type of a field, VOID for an explicit null; null if the field is not there."""
    return F.schema_of_variant(F.try_variant_get(document, f"$.{field}", "variant"))


def _kinds(document: Column, fields: Sequence[str]) -> Column:
    """The JSON types of fields."""
    return F.struct(*[_kind(document, f).alias(f) for f in fields])


def _not(kinds: Column, field: str, *allowed: str) -> Column:
    """Whether a field is there and of none of the types."""
    return F.coalesce(~kinds[field].isin(*allowed), F.lit(False))


def _action_errors(action: Column, kinds: Column) -> Column:
    """What is wrong with an action; one that is null is one error."""
    missing = F.array(F.struct(F.lit("invalid_field").alias("code"), F.lit("actions").alias("detail")))
    return F.when(action.isNull(), missing).otherwise(_field_errors(action, kinds))


def _field_errors(action: Column, kinds: Column) -> Column:
    columns = F.coalesce(action["columns"], _empty_list("string"))
    scope = F.coalesce(action["model_scope"], F.lit("all"))
    return F.array_compact(
        F.array(
            _when(
                _mismatch(action["action_id"], IDENTIFIER) | _not(kinds, "action_id", "STRING"),
                "invalid_field",
                "action_id",
            ),
            _when(
                _mismatch(action["transformation"], TRANSFORMATION_NAME)
                | _not(kinds, "transformation", "STRING"),
                "invalid_field",
                "transformation",
            ),
            _when(
                _blank(action["rationale"]) | _not(kinds, "rationale", "STRING"),
                "invalid_field",
                "rationale",
            ),
            _when(
                ~scope.isin(*SCOPES) | _not(kinds, "model_scope", "STRING"),
                "invalid_field",
                "model_scope",
            ),
            _when(
                (F.size(columns) != F.size(F.array_distinct(columns)))
                | F.exists(columns, lambda c: F.coalesce(c.rlike(r"\A\s*\z"), F.lit(True)))
                | _not(kinds, "columns", "ARRAY<STRING>", "ARRAY<VOID>"),
                "invalid_field",
                "columns",
            ),
            _when(
                F.coalesce(~kinds["parameters"].startswith("OBJECT"), F.lit(False)),
                "invalid_field",
                "parameters",
            ),
        )
    )


def parse_plans(df: DataFrame, json: str = "plan_json") -> DataFrame:
    """Add the plan's fields and ``shape_errors``, an array of ``(code, detail)``.

    Nothing raises: a plan is usable where the array is empty. Missing columns and parameters
    become empty ones and a missing scope becomes ``all``. Plans are dealt over all cores first, as a
    plan takes far longer to check than to read.
    """
    text = col(json)
    broken = "_broken"
    parsed = computed_once(
        spread(df),
        _plan=F.from_json(
            text, f"{PLAN_DDL}, {broken} string", {"columnNameOfCorruptRecord": broken}
        ),
        _raw=F.from_json(text, "actions array<string>")["actions"],
    )
    # Parsed once each: the types of an action's fields, and of the plan's own.
    documents = F.transform(F.coalesce("_raw", _empty_list("string")), F.try_parse_json)
    # Inside brackets, text behind the closing brace is malformed or a second element.
    parsed = computed_once(
        parsed,
        _action_kinds=F.transform(documents, lambda d: _kinds(d, ACTION_FIELDS)),
        _alone=F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))),
    )
    document = F.try_variant_get("_alone", "$[0]", "variant")
    parsed = computed_once(
        parsed, _second=F.try_variant_get("_alone", "$[1]", "variant").isNotNull(), _plan_kinds=_kinds(document, PLAN_FIELDS)
    )
    kinds = F.col("_plan_kinds")
    plan = F.col("_plan")
    actions = F.coalesce(plan["actions"], F.array().cast(parsed.schema["_plan"].dataType["actions"].dataType))
    ids = F.transform(actions, lambda a: a["action_id"])
    unreadable = text.isNull() | plan.isNull() | plan[broken].isNotNull()
    unreadable = unreadable | F.col("_alone").isNull() | F.col("_second")
    raws = F.coalesce(F.col("_raw"), _empty_list("string"))
    fields = F.array_compact(
        F.array(
            _when(
                _mismatch(plan["plan_id"], IDENTIFIER) | _not(kinds, "plan_id", "STRING"),
                "invalid_field",
                "plan_id",
            ),
            _when(
                _blank(plan["dataset_id"]) | _not(kinds, "dataset_id", "STRING"),
                "invalid_field",
                "dataset_id",
            ),
            _when(
                ~F.coalesce((plan["iteration"] >= 1) & (plan["iteration"] % 1 == 0), F.lit(False)),
                "invalid_field",
                "iteration",
            ),
            _when(
                _blank(plan["objective"]) | _not(kinds, "objective", "STRING"),
                "invalid_field",
                "objective",
            ),
            _when(
                F.coalesce(~kinds["actions"].startswith("ARRAY"), F.lit(False)),
                "invalid_field",
                "actions",
            ),
            _when(
                F.size(ids) != F.size(F.array_distinct(ids)), "repeated_action_id", "actions"
            ),
        )
    )
    errors = F.concat(
        fields,
        _unknown_keys(text, PLAN_FIELDS),
        F.flatten(F.transform(actions, lambda a, i: _action_errors(a, F.get("_action_kinds", i)))),
        F.flatten(F.transform(raws, lambda raw: _unknown_keys(raw, ACTION_FIELDS))),
    )
    filled = F.transform(
        actions,
        lambda a: a.withField("columns", F.coalesce(a["columns"], _empty_list("string")))
        .withField(
            "parameters",
            F.coalesce(a["parameters"], F.create_map().cast("map<string,variant>")),
        )
        .withField("model_scope", F.coalesce(a["model_scope"], F.lit("all"))),
    )
    failed = F.array(
        F.struct(F.lit("malformed_json").alias("code"), F.lit("plan").alias("detail"))
    )
    checked = computed_once(
        parsed, actions=filled, shape_errors=F.when(unreadable, failed).otherwise(errors)
    )
    return checked.select(
        *df.columns,
        *[
            plan[f].cast("int").alias(f) if f == "iteration" else plan[f].alias(f)
            for f in PLAN_FIELDS
            if f != "actions"
        ],
        "actions",
        "shape_errors",
    )
