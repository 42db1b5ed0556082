import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.rules import applicable, transaction_rules
from plumbline.operators import profile as pf
from plumbline.operators.ordering import exact_quantiles
from plumbline.operators.quality import bounded_score, quality_of, quality_score

DEFECTS = [
    (1, "PAYMENT", 10.0, 0, 0, 0, math.log(11), 0, 0, 1),
    (2, "TRANSFER", 100.0, 1, 1, 0, math.log(101), 1, 0, 0),
    (2, "TRANSFER", 100.0, 1, 1, 0, math.log(101), 1, 0, 0),
    (2, "UNKNOWN", -5.0, 3, 25, -1, None, 0, 2, 0),
]
DDL = (
    "step long, type string, amount double, isFraud long, hour long, day long, "
    "log_amount double, is_transfer long, is_cash_out long, is_merchant_destination long"
)


@pytest.fixture
def defects(spark):
    return spark.createDataFrame(DEFECTS, DDL)


def test_planted_defects_are_counted(spark, defects):
    rules = applicable(transaction_rules(), defects.columns)
    failures = {r["rule"]: r["failures"] for r in pf.check_rules(defects, rules).collect()}
    totals = {r["kind"]: r["failures"] for r in pf.rule_totals(pf.check_rules(defects, rules)).collect()}
    assert totals == {"validity": 6, "consistency": 3}
    assert failures["unknown_transaction_type"] == 1
    assert failures["log_amount_inconsistent_with_amount"] == 0
    dup = pf.duplicate_rows(defects).first()
    assert (dup["duplicate_rows"], dup["duplicate_rate"]) == (1, 0.25)
    columns = {r["column"]: r for r in pf.column_profile(defects).collect()}
    assert columns["log_amount"]["null_count"] == 1
    assert columns["log_amount"]["n_unique"] == 3
    assert columns["step"]["min"] == 1 and columns["step"]["max"] == 2
    classes = {r["value"]: r["count"] for r in pf.value_distribution(defects, "isFraud").collect()}
    assert classes == {0: 1, 1: 2, 3: 1}


def test_rules_need_their_columns(defects):
    names = {r.name for r in applicable(transaction_rules(), ["step", "hour"])}
    assert names == {"step_non_positive", "hour_outside_0_23", "hour_inconsistent_with_step"}


def test_null_is_no_failure_and_one_distinct_value(spark):
    df = spark.createDataFrame([(None,), (None,), (5,)], "step long")
    rules = applicable(transaction_rules(), df.columns)
    assert pf.check_rules(df, rules).first()["failures"] == 0
    assert pf.distinct_counts(df).first()["n_unique"] == 2
    assert pf.distinct_counts(df, approximate=True).first()["n_unique"] == 2


def test_statistics_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.exponential(10, 501), [-3.0, 0.0, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    row = pf.column_profile(df.repartition(5)).first()
    skew = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert row["mean"] == pytest.approx(x.mean())
    assert row["std"] == pytest.approx(x.std(ddof=1))
    assert row["skewness"] == pytest.approx(skew)
    assert row["median"] == pytest.approx(np.median(x))
    assert (row["min"], row["max"], row["null_count"]) == (x.min(), x.max(), 1)


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [7.0] * 9 + [1.0], [-1e300, -2.5, 0.0, 1e-300, 3.0, float("inf")],
    list(range(100)),
])
def test_exact_quantiles(spark, values):
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    found = {
        r["probability"]: r["quantile"] for r in exact_quantiles(df, ["v"], probs, ["g"]).collect()
    }
    finite = [v for v in values if math.isfinite(v)]
    if len(finite) == len(values):
        for p in probs:
            assert found[p] == pytest.approx(np.quantile(values, p))
    else:
        assert found[0.0] == -1e300 and found[0.5] == pytest.approx(5e-301)


@pytest.mark.parametrize("values, median", [
    ([1, 2], 1.5), ([7], 7), ([5, 5, 9], 5), ([-3, 4, 4, 10], 4), ([10**12, 10**12 + 1], 10**12 + 0.5),
])
def test_profile_median_of_few_values(spark, values, median):
    df = spark.createDataFrame([(v, "t", None) for v in values], "x long, s string, e double")
    rows = {r["column"]: r for r in pf.column_profile(df).collect()}
    assert rows["x"]["median"] == median
    assert rows["x"]["n_unique"] == len(set(values))
    assert rows["s"]["median"] is None and rows["s"]["n_unique"] == 1
    assert rows["e"]["median"] is None and rows["e"]["n_unique"] == 1


def test_profile_of_odd_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, 2.0)], "`a.b` int, `it's` double")
    assert {r["column"]: r["max"] for r in pf.column_profile(df).collect()} == {"a.b": 1, "it's": 2}
    empty = {r["column"]: r for r in pf.column_profile(df.limit(0)).collect()}
    assert empty["a.b"]["rows"] == 0 and empty["a.b"]["n_unique"] == 0
    assert empty["a.b"]["null_rate"] is None


def test_approximate_profile(spark):
    df = spark.createDataFrame([(float(i), str(i % 3)) for i in range(100)], "x double, s string")
    rows = {r["column"]: r for r in pf.column_profile(df, approximate=True).collect()}
    assert abs(rows["x"]["median"] - 49.5) <= 1 and rows["s"]["n_unique"] == 3


def test_more_columns_than_one_aggregate_holds(spark):
    df = spark.range(10).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(30)])
    rows = pf.column_profile(df).orderBy("position").collect()
    assert [r["max"] for r in rows] == [9.0 * i for i in range(30)]


def test_long_text_is_compared_by_digest_and_shown_whole(spark):
    long = "x" * 100
    df = spark.createDataFrame([(long,), (long,), ("y" * 100,), (None,), ("s",)], "t string")
    assert pf.duplicate_rows(df).first()["duplicate_rows"] == 1
    top = {r["value"]: r["count"] for r in pf.top_values(df).collect()}
    assert top == {long: 2, "y" * 100: 1, "s": 1, None: 1}


def test_top_values_limit_and_ties(spark):
    df = spark.createDataFrame([(f"v{i:02d}",) for i in range(30)] + [("v29",)], "t string")
    rows = pf.top_values(df, k=20).orderBy("rank").collect()
    assert [r["value"] for r in rows] == ["v29"] + [f"v{i:02d}" for i in range(19)]


def test_report_is_one_row(spark, defects):
    rules = applicable(transaction_rules(), defects.columns)
    row = pf.profile_report(defects, "isFraud", "step", rules).first()
    assert row["dimensions"].asDict() == {"rows": 4, "columns": 10}
    assert row["duplicates"]["duplicate_rows"] == 1
    assert row["time_range"].asDict() == {"column": "step", "min": 1, "max": 2}
    assert row["class_imbalance"]["detected"] is False
    assert len(row["columns"]) == 10 and len(row["rule_failures"]) == len(rules)
    with pytest.raises(ValueError):
        pf.profile_report(defects, "absent", "step")


def counts(spark, **changes):
    base = dict(rows=10, columns=2, missing_cells=2, validity_checks=2, validity_failures=1,
                consistency_checks=1, consistency_failures=2, duplicate_rows=1)
    base.update(changes)
    ddl = ", ".join(f"{c} long" for c in base)
    return spark.createDataFrame([tuple(base.values())], ddl)


def test_quality_score(spark):
    row = quality_score(counts(spark)).first()
    assert row["completeness"] == pytest.approx(0.90)
    assert row["validity"] == pytest.approx(0.95)
    assert row["consistency"] == pytest.approx(0.80)
    assert row["uniqueness"] == pytest.approx(0.90)
    assert row["data_quality_score"] == pytest.approx(0.8875)


@pytest.mark.parametrize("rows, columns, missing, duplicates, score", [
    (72149, 9, 3607, 98, 0.9980618812),
    (72149, 9, 0, 100, 0.9997227959),
    (6239040, 10, 0, 7526, 0.9997587449),
])
def test_published_scores(spark, rows, columns, missing, duplicates, score):
    row = quality_score(
        counts(spark, rows=rows, columns=columns, missing_cells=missing, validity_checks=0,
               validity_failures=0, consistency_checks=0, consistency_failures=0,
               duplicate_rows=duplicates)
    ).first()
    assert row["data_quality_score"] == pytest.approx(score, abs=1e-10)


def test_impossible_counts_fail(spark):
    for bad in ({"duplicate_rows": 11}, {"missing_cells": -1},
                {"validity_checks": 0, "validity_failures": 1}):
        with pytest.raises(Exception, match="uality"):
            quality_score(counts(spark, **bad)).collect()
    for weights in ({"completeness": .3, "validity": .25, "consistency": .25, "uniqueness": .25},
                    {"completeness": 1.2, "validity": -.2, "consistency": 0, "uniqueness": 0},
                    {"completeness": 1.0}):
        with pytest.raises(ValueError):
            quality_score(counts(spark), weights)


def test_nan_counts_as_missing_for_quality(spark):
    df = spark.createDataFrame([(float("nan"), 1), (1.0, 2)], "x double, y int")
    assert quality_of(df).first()["missing_cells"] == 1


def test_bounded_score_without_chances(spark):
    assert spark.range(1).select(bounded_score(F.lit(0), F.lit(0)).alias("s")).first()["s"] == 1.0


def test_top_values_of_mostly_distinct_texts(spark):
    start = "s" * 70
    texts = [f"{start}{k:03d}" for k in range(40)] + [f"{k:03d}" + "x" * 100 for k in range(200)]
    texts += [f"{start}007"] * 2 + ["short", "short", None, ""]
    df = spark.createDataFrame([(t, "c" if k % 3 else None) for k, t in enumerate(texts)], "a string, b string")
    for k in (1, 2, 5, 60, 400):
        got = [(r["column"], r["rank"], r["value"], r["count"]) for r in pf.top_values(df.repartition(5), None, k).collect()]
        want = []
        for i, c in enumerate("ab"):
            values = [t if i == 0 else ("c" if j % 3 else None) for j, t in enumerate(texts)]
            counts = sorted(((-values.count(v), v is None, v or "", v) for v in set(values)))[:k]
            want += [(c, r, v, -n) for r, (n, _, _, v) in enumerate(counts, 1)]
        assert sorted(got, key=repr) == sorted(want, key=repr)
