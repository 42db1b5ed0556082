import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators.quality import quality_of
from plumbline.plans.application import (
    Action,
    Plan,
    applied_actions,
    apply_plan,
    learn_plan,
    plan_quality,
    read_plan,
)
from plumbline.plans.audit import audit_plans, columns_catalog, plan_verdicts
from plumbline.plans.parsing import parse_plans

KINDS = {"amount": "numeric", "log_amount": "numeric", "type": "categorical",
         "is_transfer": "binary", "isFraud": "target"}


def action(transformation, columns=(), action_id="a1", scope="all", **parameters):
    return {"action_id": action_id, "transformation": transformation, "columns": list(columns),
            "parameters": parameters, "rationale": "because", "model_scope": scope}


def plan(*actions, **changes):
    return {"plan_id": "p1", "dataset_id": "d", "iteration": 1, "objective": "better",
            "actions": list(actions), **changes}


def parsed(spark, *bodies):
    texts = [(b if isinstance(b, str) else json.dumps(b),) for b in bodies]
    return parse_plans(spark.createDataFrame(texts, "plan_json string"))


@pytest.fixture
def catalog(spark):
    df = spark.createDataFrame(
        [], "amount double, log_amount double, type string, is_transfer int, isFraud int"
    )
    return columns_catalog(df, KINDS)


def codes(spark, catalog, body, role="development", allowed=None):
    p = parsed(spark, body)
    assert p.first()["shape_errors"] == []
    found = audit_plans(p, catalog, "d", role, allowed).collect()
    verdict = plan_verdicts(p, catalog, "d", role, allowed).first()
    assert verdict["is_valid"] == (not found) and verdict["issue_count"] == len(found)
    return sorted(r["code"] for r in found)


def test_valid_plan(spark, catalog):
    body = plan(
        action("impute_numeric", ["amount"], "a1", strategy="median"),
        action("impute_categorical", ["type"], "a2", strategy="constant", fill_value="X"),
        action("scale_numeric", ["amount", "log_amount"], "a3", "logistic_regression", method="robust"),
        action("log_transform", ["amount"], "a4"),
        action("one_hot_encode", ["type"], "a5"),
        action("class_weight", [], "a6", mode="balanced"),
        action("resample_classes", [], "a7", method="smote", random_seed=42),
    )
    assert codes(spark, catalog, body) == []


@pytest.mark.parametrize("act, expected", [
    (action("execute_python", ["amount"]), ["transformation_not_allowed"]),
    (action("scale_numeric", ["gone", "isFraud"], method="standard"),
     ["column_not_found", "incompatible_column_type", "protected_column_reference"]),
    (action("impute_numeric", ["type"], strategy="magic", unexpected=True),
     ["incompatible_column_type", "invalid_parameter", "unknown_parameter"]),
    (action("impute_numeric", [], strategy="mean"), ["columns_required"]),
    (action("class_weight", ["amount"], mode="balanced"),
     ["columns_not_allowed", "incompatible_column_type"]),
    (action("class_weight", []), ["invalid_parameter"]),
    (action("impute_categorical", ["type"], strategy="constant"), ["missing_parameter"]),
    (action("one_hot_encode", ["type"], handle_unknown="error"), ["unsafe_parameter"]),
    (action("one_hot_encode", ["type"], handle_unknown=None), ["unsafe_parameter"]),
    (action("log_transform", ["amount"], base=2), ["unknown_parameter"]),
    (action("resample_classes", [], method="smote", random_seed="42"), ["invalid_parameter"]),
    (action("resample_classes", [], method="smote", random_seed=True), ["invalid_parameter"]),
    (action("resample_classes", [], method="smote", random_seed=1.5), ["invalid_parameter"]),
    (action("resample_classes", []), ["invalid_parameter", "invalid_parameter"]),
    (action("scale_numeric", ["is_transfer"], method="robust"), ["incompatible_column_type"]),
])
def test_issue_codes(spark, catalog, act, expected):
    assert codes(spark, catalog, plan(act)) == expected


def test_roles_datasets_and_allowlist(spark, catalog):
    assert codes(spark, catalog, plan(), "temporal_test") == ["temporal_test_access_forbidden"]
    assert codes(spark, catalog, plan(dataset_id="x")) == ["dataset_mismatch"]
    sample = plan(action("resample_classes", [], method="smote", random_seed=1))
    assert codes(spark, catalog, sample, "validation_fold") == ["sampling_outside_training_forbidden"]
    assert codes(spark, catalog, sample, allowed=["log_transform"]) == ["transformation_not_allowed"]
    with pytest.raises(ValueError, match="role"):
        audit_plans(parsed(spark, plan()), catalog, "d", "production")
    with pytest.raises(ValueError, match="not known"):
        audit_plans(parsed(spark, plan()), catalog, "d", allowed=["magic"])


def test_duplicates(spark, catalog):
    one = action("impute_categorical", ["type"], "a1", strategy="constant", fill_value=42)
    same = {**one, "action_id": "a2", "parameters": {"fill_value": 42, "strategy": "constant"}}
    other = {**one, "action_id": "a3", "parameters": {"fill_value": "42", "strategy": "constant"}}
    scoped = {**one, "action_id": "a4", "model_scope": "random_forest"}
    again = {**one, "action_id": "a5"}
    assert codes(spark, catalog, plan(one, same, other, scoped, again)) == ["duplicate_action"] * 2


def test_shape_errors(spark):
    ok = action("log_transform", ["amount"])
    bodies = {
        "nonsense": [("malformed_json", "plan")],
        "[]": [("malformed_json", "plan")],
        json.dumps(plan(extra=1)): [("unknown_field", "extra")],
        json.dumps(plan({**ok, "python_code": "import os"})): [("unknown_field", "python_code")],
        json.dumps(plan(ok, ok)): [("repeated_action_id", "actions")],
        json.dumps(plan(iteration=0)): [("invalid_field", "iteration")],
        json.dumps(plan(iteration=1.5)): [("invalid_field", "iteration")],
        json.dumps(plan(iteration=2.0)): [],
        json.dumps(plan(actions=[None])): [("invalid_field", "actions")],
        json.dumps(plan(plan_id="a b")): [("invalid_field", "plan_id")],
        json.dumps(plan(objective="")): [("invalid_field", "objective")],
        json.dumps(plan({**ok, "columns": ["x", "x"]})): [("invalid_field", "columns")],
        json.dumps(plan({**ok, "columns": [" "]})): [("invalid_field", "columns")],
        json.dumps(plan({**ok, "transformation": "Bad-Name"})): [("invalid_field", "transformation")],
        json.dumps(plan({**ok, "model_scope": "svm"})): [("invalid_field", "model_scope")],
        json.dumps(plan({**ok, "rationale": ""})): [("invalid_field", "rationale")],
    }
    for r in parsed(spark, *bodies).collect():
        assert [tuple(e) for e in r["shape_errors"]] == bodies[r["plan_json"]]


def test_omitted_fields_get_defaults(spark):
    short = plan({"action_id": "a", "transformation": "log_transform", "rationale": "r"})
    row = parsed(spark, short).select(F.inline("actions")).first()
    assert row["columns"] == [] and row["parameters"] == {} and row["model_scope"] == "all"


def test_catalog_needs_one_target(spark):
    df = spark.createDataFrame([], "a int")
    with pytest.raises(ValueError, match="target"):
        columns_catalog(df, {"a": "numeric"})
    with pytest.raises(ValueError, match="kinds"):
        columns_catalog(df, {"a": "other"})
    with pytest.raises(ValueError, match="exist"):
        columns_catalog(df, {"b": "target"})


TRAIN = [(1, 10.0, "PAYMENT", 0), (2, 20.0, "PAYMENT", 0), (3, None, "CASH_OUT", 0), (4, 40.0, None, 0),
         (5, 100.0, "TRANSFER", 0), (6, 120.0, "TRANSFER", 0), (7, 140.0, "CASH_OUT", 1), (8, 160.0, "TRANSFER", 1)]
SIX = Plan("p", "d", 1, (
    Action("i1", "impute_numeric", ("amount",), {"strategy": "median"}),
    Action("s1", "scale_numeric", ("amount",), {"method": "robust"}, "logistic_regression"),
    Action("i2", "impute_categorical", ("type",), {"strategy": "most_frequent"}),
    Action("h1", "one_hot_encode", ("type",), {"handle_unknown": "ignore"}),
    Action("w1", "class_weight", (), {"mode": "balanced"}),
    Action("o1", "resample_classes", (), {"method": "random_oversampling", "random_seed": 42}),
))


@pytest.fixture
def train(spark):
    return spark.createDataFrame(TRAIN, "id int, amount double, type string, y int")


def test_six_action_plan(train):
    learned = learn_plan(train, SIX, "logistic_regression", "d", "development")
    assert [a.action_id for a in learned.applied] == ["i1", "s1", "i2", "h1", "w1", "o1"]
    assert learned.class_weight
    out = learned.transform(train)
    assert out.columns == ["id", "amount", "y", "type=CASH_OUT", "type=PAYMENT", "type=TRANSFER"]
    assert out.where("amount is null").count() == 0
    filled = {r["id"]: r["type=TRANSFER"] for r in out.collect()}
    assert filled[4] == 1
    balanced = learned.resample(out, "y", ["id"]).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in balanced} == {0: 6, 1: 6}
    assert applied_actions(train, learned).count() == 6


def test_scope_roles_and_unknown_actions(train):
    scoped = Plan("p", "d", 1, (SIX.actions[1],))
    learned = learn_plan(train, scoped, "decision_tree")
    assert learned.applied == () and learned.transform(train) is train
    for role in ("validation_fold", "temporal_test"):
        with pytest.raises(ValueError, match="forbidden"):
            learn_plan(train, SIX, "random_forest", role=role)
    with pytest.raises(ValueError, match="another dataset"):
        learn_plan(train, SIX, "random_forest", dataset_id="other")
    with pytest.raises(ValueError, match="No transformation"):
        learn_plan(train, SIX, "random_forest", learners={})
    twice = Plan("p", "d", 1, (SIX.actions[5], SIX.actions[5]))
    with pytest.raises(ValueError, match="one class sampler"):
        learn_plan(train, twice, "random_forest")


def test_plan_is_learned_on_training_rows_only(spark, train):
    other = spark.createDataFrame([(9, None, "NEW", 0)], train.schema)
    row = apply_plan(other, SIX, "random_forest", train).first()
    assert row["amount"] == 100.0 and row["type=TRANSFER"] == 0 and row["type=PAYMENT"] == 0


def test_read_plan():
    made = read_plan(json.dumps(plan(action("log_transform", ["amount"]))))
    assert made.actions[0] == Action("a1", "log_transform", ("amount",), {}, "all")


def test_imputation_raises_quality(train):
    both = {r["stage"]: r for r in plan_quality(train.drop("id"), SIX).collect()}
    assert both["before"]["missing_cells"] == 2 and both["after"]["missing_cells"] == 0
    assert both["after"]["data_quality_score"] > both["before"]["data_quality_score"]
    assert both["before"]["data_quality_score"] == quality_of(train.drop("id")).first()["data_quality_score"]
    with pytest.raises(ValueError, match="development"):
        plan_quality(train, SIX, "temporal_test")


def test_wrong_types_nulls_and_trailing_text(spark):
    action = {"action_id": "a", "transformation": "scale", "columns": ["x"], "parameters": {},
              "rationale": "r", "model_scope": "all"}
    plan = {"plan_id": "p", "dataset_id": "d", "iteration": 1, "objective": "o", "actions": [action]}
    of_plan = lambda **kv: json.dumps({**plan, **kv})
    of_action = lambda **kv: of_plan(actions=[{**action, **kv}])
    cases = [
        (of_plan(), None), (of_action(columns=[]), None), (of_action(parameters={"q": [1]}), None),
        (of_plan(plan_id=5), "plan_id"), (of_plan(plan_id="p\n"), "plan_id"), (of_plan(actions=None), "actions"),
        (of_action(columns=None), "columns"), (of_action(columns=[1]), "columns"), (of_action(columns=["\t"]), "columns"),
        (of_action(parameters=None), "parameters"), (of_action(model_scope=None), "model_scope"),
        (of_plan() + " x", "plan"), (of_plan() + ", {}", "plan"), ("", "plan"),
    ]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k long, plan_json string")
    got = {r.k: [e["detail"] for e in r.shape_errors] for r in parse_plans(rows).collect()}
    assert [got[k] for k in range(len(cases))] == [[d] if d else [] for _, d in cases]


def test_plans_of_several_datasets(spark):
    one = spark.createDataFrame([], "amount double, isFraud int")
    two = spark.createDataFrame([], "price double, sold int")
    both = columns_catalog(one, {"amount": "numeric", "isFraud": "target"}, (), "one").unionByName(
        columns_catalog(two, {"price": "numeric", "sold": "target"}, (), "two"))
    asked = action("scale_numeric", ["amount", "price"], method="robust")
    plans = parsed(spark, *[plan(asked, plan_id=d, dataset_id=d) for d in ("one", "two", "three")])
    found = audit_plans(plans, both, F.col("dataset_id")).collect()
    assert sorted((r["plan_id"], r["code"], r["detail"]) for r in found) == [
        ("one", "column_not_found", "price"), ("three", "column_not_found", "amount"),
        ("three", "column_not_found", "price"), ("two", "column_not_found", "amount")]


def test_plans_for_another_attempt(spark, catalog):
    plans = parsed(spark, plan(action("log_transform", ["amount"]), iteration=2))
    assert audit_plans(plans, catalog, "d", iteration=2).isEmpty() and audit_plans(plans, catalog, "d").isEmpty()
    (r,) = audit_plans(plans, catalog, "d", iteration=3).collect()
    assert (r["code"], r["detail"], r["action_id"]) == ("iteration_mismatch", "2", None)
    assert not plan_verdicts(plans, catalog, "d", iteration=3).first()["is_valid"]


def test_plans_of_one_file_are_checked_by_many_tasks(spark, catalog):
    text = json.dumps(plan(action("log_transform", ["amount"])))
    one = spark.range(0, 4000, 1, 1).select("id", F.lit(text).alias("plan_json"))
    rows = parse_plans(one)
    held = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in held) < 1000
    assert rows.where("size(shape_errors) = 0").select("id").distinct().count() == 4000
    assert audit_plans(rows, catalog, "d").isEmpty()
