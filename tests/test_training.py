import pytest
from pyspark.sql import functions as F

from plumbline.catalogue import QUERIES, evaluation
from plumbline.operators.folds import stratified_folds, training_rows
from plumbline.plans.application import SPARSE_LEARNERS, Action, Plan, learn_plan
from plumbline.training.benchmark import (
    NUMERIC_FEATURES,
    benchmark,
    candidate_evidence,
    compare_on_holdout,
    fixed_plan,
    fold_facts,
    require_model_features,
)
from plumbline.training.estimators import create_estimator

QUICK = {
    "logistic_regression": {"max_iter": 20},
    "decision_tree": {"max_depth": 4},
    "random_forest": {"trees": 3, "max_depth": 4},
}


@pytest.fixture(scope="module")
def sample(spark):
    i = F.col("id")
    return spark.range(40).select(
        "id",
        F.when(i % 2 == 0, "PAYMENT").otherwise("TRANSFER").alias("type"),
        (i % 20 + 1).alias("step"),
        (i % 20).alias("hour"),
        F.lit(0).alias("day"),
        (i * 10.0).alias("amount"),
        F.log1p(i * 10.0).alias("log_amount"),
        (i % 2).alias("is_transfer"),
        F.lit(0).alias("is_cash_out"),
        F.lit(1).alias("is_merchant_destination"),
        (i >= 24).cast("long").alias("isFraud"),
    )


def test_benchmark_shape_and_repeatability(sample):
    models = ["logistic_regression", "decision_tree"]
    folds = stratified_folds(sample, "isFraud", ["id"], 2, 2)
    first = benchmark(sample, fixed_plan("d"), "isFraud", ["id"], 2, 2, models=models,
                      settings=QUICK, assigned=folds, parallelism=4)
    assert {r["model"]: r["count"] for r in first.fold_metrics.groupBy("model").count().collect()} == {
        m: 4 for m in models}
    assert {r["model"]: r["count"] for r in first.predictions.groupBy("model").count().collect()} == {
        m: 80 for m in models}
    assert first.fold_metrics.where("train_rows + validation_rows <> 40").isEmpty()
    assert first.fold_metrics.agg(F.min("roc_auc")).first()[0] > 0.9
    assert first.predictions.where("y_score < 0 or y_score > 1").isEmpty()


def test_failed_folds_are_rows(sample):
    broken = Plan("bad", "d", 1, (Action("a", "log_transform", ("type",)),))
    result = benchmark(sample, broken, "isFraud", ["id"], 2, 1, models=["decision_tree"])
    rows = result.fold_results.collect()
    assert len(rows) == 2 and {r["status"] for r in rows} == {"error"}
    assert all(r["error_type"] and r["roc_auc"] is None for r in rows)
    assert result.fold_metrics.isEmpty() and result.predictions.isEmpty()


def test_complete_metrics_refuse_failed_folds(sample):
    broken = Plan("bad", "d", 1, (Action("a", "log_transform", ("type",)),))
    result = benchmark(sample, broken, "isFraud", ["id"], 2, 1, models=["decision_tree"])
    assert sorted(f.split(":")[0] for f in result.failures) == [f"decision_tree, repeat 1, fold {f}" for f in (1, 2)]
    with pytest.raises(RuntimeError, match="folds that failed: 2, first:\ndecision_tree, repeat 1, fold"):
        result.complete_metrics
    whole = benchmark(sample, fixed_plan("d"), "isFraud", ["id"], 2, 1, models=["decision_tree"], settings=QUICK)
    assert not whole.failures and whole.complete_metrics.columns == whole.fold_metrics.columns
    assert whole.complete_metrics.count() == 2


def test_ml_benchmark_fails_with_a_fold(spark, sample, monkeypatch):
    """One lost fit of several is an error of the query, not a row less."""
    from plumbline.training import benchmark as module

    plain, calls = module.fit_and_score, []

    def lost(*args, **settings):
        calls.append(1)
        if len(calls) == 2:
            raise MemoryError("executor lost")
        return plain(*args, **settings)

    rows = sample.withColumnRenamed("id", "event_id").drop("amount", "log_amount")
    monkeypatch.setattr(module, "fit_and_score", lost)
    monkeypatch.setattr(evaluation, "_model_table", lambda *_: rows)
    monkeypatch.setattr(evaluation, "case_control_sample", lambda df, *_: df)
    monkeypatch.setattr(
        evaluation, "benchmark",
        lambda sample, plan, target, key, *_: benchmark(
            sample, plan, target, key, 2, 1, models=["decision_tree"], settings=QUICK, parallelism=1),
    )
    with pytest.raises(RuntimeError, match="folds that failed: 1, first:\ndecision_tree, .*MemoryError: executor lost"):
        QUERIES["ml_benchmark"](spark, "")
    assert len(calls) == 2
    assert QUERIES["ml_benchmark"](spark, "").count() == 2


def test_a_fold_of_one_class_is_an_error_row(sample):
    # Fold 3 has no positive rows; fold 1 has all others of its class for training.
    fold = F.when(F.col("id") < 6, 3).when(F.col("id") % 2 == 0, 1).otherwise(2)
    folds = sample.select("id", "isFraud", F.lit(1).alias("repeat"), fold.alias("fold"))
    result = benchmark(sample, fixed_plan("d"), "isFraud", ["id"], 3, 1, models=["decision_tree", "logistic_regression"],
                       settings=QUICK, assigned=folds)
    rows = {(r["model"], r["fold"]): r for r in result.fold_results.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        (m, f): "error" if f == 3 else "success" for m in ("decision_tree", "logistic_regression") for f in (1, 2, 3)}
    for (_, f), r in rows.items():
        assert (r["roc_auc"] is None) == (f == 3) and (r["error_type"] == "ValueError") == (f == 3)
        assert (r["train_rows"], r["validation_rows"]) == {1: (23, 17), 2: (23, 17), 3: (34, 6)}[f]
    assert {r["fold"] for r in result.predictions.select("fold").distinct().collect()} == {1, 2}
    lone = sample.select("id", "isFraud", F.lit(1).alias("repeat"), (F.col("isFraud") + 1).cast("int").alias("fold"))
    result = benchmark(sample, fixed_plan("d"), "isFraud", ["id"], 2, 1, models=["decision_tree"], assigned=lone)
    assert {r["status"] for r in result.fold_results.collect()} == {"error"} and result.predictions.isEmpty()


def test_facts_of_folds_equal_those_of_their_training_rows(spark, sample):
    rows = sample.withColumns({
        "type": F.when(F.col("id") % 7 > 0, F.col("type")), "step": F.when(F.col("id") % 5 > 0, F.col("step"))})
    plan = Plan("p", "d", 1, (
        Action("f", "impute_categorical", ("type",), {"strategy": "most_frequent"}),
        Action("h", "one_hot_encode", ("type",), {}),
        Action("m", "impute_numeric", ("step",), {"strategy": "median"}),
        Action("s", "scale_numeric", ("hour", "amount"), {"method": "standard"}),
        Action("r", "scale_numeric", ("log_amount", "step"), {"method": "robust"}),
    ))
    folds = stratified_folds(rows, "isFraud", ["id"], 3, 2).drop("isFraud")
    data = rows.join(folds, "id")
    facts = fold_facts(data, plan, ["decision_tree"], 3)
    for repeat, fold in [(1, 1), (1, 3), (2, 2)]:
        train = training_rows(data, repeat, fold).drop("repeat", "fold")
        direct = learn_plan(train, plan, "decision_tree").transform(rows).orderBy("id").collect()
        known = learn_plan(train, plan, "decision_tree", learners=SPARSE_LEARNERS, facts=facts[repeat, fold])
        got = known.transform(rows).orderBy("id").collect()
        kinds = sorted(c for c in direct[0].asDict() if c.startswith("type="))
        assert len(kinds) == 2
        for a, b in zip(direct, got, strict=True):
            for c in ("step", "hour", "amount", "log_amount"):
                assert b[c] == pytest.approx(a[c])
            assert sorted(b["type"].toArray().tolist()) == sorted(a[k] for k in kinds)
        assert len({(tuple(a[k] for k in kinds), tuple(b["type"].toArray())) for a, b in zip(direct, got, strict=True)}) == 2


def test_actions_that_learn_alike_share_a_job(spark, sample, monkeypatch):
    from plumbline.operators import transforms

    asked = []
    plain = transforms.exact_quantiles
    monkeypatch.setattr(transforms, "exact_quantiles", lambda df, c, p, *a, **k: asked.append(list(c)) or plain(df, c, p, *a, **k))
    plan = Plan("p", "d", 1, tuple(
        Action(f"a{k}", "scale_numeric", (c,), {"method": "robust"}) for k, c in enumerate(["step", "hour", "amount"])))
    learn_plan(sample, plan, "decision_tree")
    assert asked == [["step", "hour", "amount"]]


def test_evidence_and_holdout(sample):
    plan = Plan("p", "d", 1, (
        Action("h", "one_hot_encode", ("type",), {}),
        Action("s", "scale_numeric", NUMERIC_FEATURES, {"method": "robust"}, "logistic_regression"),
        Action("r", "resample_classes", (), {"method": "smote", "random_seed": 1}),
    ))
    result = benchmark(sample, plan, "isFraud", ["id"], 2, 1, models=["decision_tree"], settings=QUICK)
    assert result.fold_metrics.count() == 2
    candidates, outcomes = candidate_evidence("r", 1, plan, sample, result, ["id"])
    assert candidates.first()["data_quality_score"] == 1.0
    assert outcomes.first()["status"] == "success" and outcomes.first()["primary_metric"] > 0.5
    metrics, scores = compare_on_holdout(
        sample, sample.where("id % 4 = 0 or id > 30"), {"fixed": fixed_plan("d"), "plan": plan},
        "isFraud", ["id"], models=["decision_tree"], settings=QUICK)
    assert {(r["pipeline"], r["model"]) for r in metrics.collect()} == {
        ("fixed", "decision_tree"), ("plan", "decision_tree")}
    assert scores.count() == 2 * metrics.first()["temporal_test_rows"]


def test_estimators():
    with pytest.raises(ValueError):
        create_estimator("svm", 1.0)


def test_estimator_settings(spark):
    lr = create_estimator("logistic_regression", 200.0)
    assert lr.getRegParam() == pytest.approx(1 / 200) and lr.getMaxIter() == 1000
    assert not lr.getStandardization()
    rf = create_estimator("random_forest", 1.0)
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getMinInstancesPerNode()) == (100, 20, 2)
    assert create_estimator("decision_tree", 1.0).getMaxDepth() == 30


def test_folds_of_another_sample_are_refused(sample):
    folds = stratified_folds(sample, "isFraud", ["id"], 2, 1)
    flipped = sample.withColumn("isFraud", 1 - F.col("isFraud"))
    with pytest.raises(ValueError, match="do not match"):
        benchmark(flipped, fixed_plan("d"), "isFraud", ["id"], 2, 1, assigned=folds)


def test_model_features_are_required(sample):
    require_model_features(sample)
    with pytest.raises(ValueError, match="hour, step"):
        require_model_features(sample.drop("step", "hour"))


@pytest.mark.parametrize(
    "name",
    ["ml_benchmark", "ml_oof_coverage_repeated", "plan_benchmark_summary", "candidate_evidence", "holdout_compare"],
)
def test_queries_train_whole(spark, small, monkeypatch, name):
    """Default settings, 5 x 5 folds and ten negatives to each positive reach the training."""
    seen = {}

    class Reached(Exception):
        pass

    def benchmark_(sample, plan, target, key, folds=5, repeats=5, seed=42, settings=None, **_):
        seen.update(sample=sample, folds=folds, repeats=repeats, settings=settings)
        raise Reached

    def compare(sample, held, plans, target, key, settings=None, **_):
        seen.update(sample=sample, folds=5, repeats=5, settings=settings)
        raise Reached

    monkeypatch.setattr(evaluation, "benchmark", benchmark_)
    monkeypatch.setattr(evaluation, "compare_on_holdout", compare)
    with pytest.raises(Reached):
        QUERIES[name](spark, small)
    assert (seen["folds"], seen["repeats"], seen["settings"]) == (5, 5, None)
    n = {r["isFraud"]: r["count"] for r in seen["sample"].groupBy("isFraud").count().collect()}
    assert n[0] == 10 * n[1] > 0


def test_models_are_fitted_on_distinct_vectors(spark, sample, monkeypatch):
    """Rows with equal features are one row with their number, as often as a leaf's least number needs."""
    from plumbline.training import benchmark as module

    fitted = []
    plain = module.create_estimator

    def create(model, *args, **settings):
        made = plain(model, *args, **settings)

        class Counted:
            def fit(self, rows):
                fitted.append((model, rows.count(), round(rows.agg(F.sum("weight")).first()[0], 6)))
                return made.fit(rows)

        return Counted()

    monkeypatch.setattr(module, "create_estimator", create)
    monkeypatch.setattr(module, "MANY_ROWS", 500)
    many = sample.crossJoin(spark.range(50).toDF("copy")).withColumn("id", F.col("id") * 50 + F.col("copy")).drop("copy")
    assigned = many.select("id", "isFraud", F.lit(1).alias("repeat"), (F.col("id") % 2 + 1).cast("int").alias("fold"))
    result = benchmark(many, fixed_plan("d"), "isFraud", ["id"], 2, 1, settings=QUICK, assigned=assigned)
    assert {r["status"] for r in result.fold_results.collect()} == {"success"}
    assert sorted(fitted) == [("decision_tree", 80, 1000.0)] * 2 + [("logistic_regression", 40, 1000.0)] * 2
    assert result.predictions.count() == 3 * 2000
    assert result.fold_metrics.agg(F.min("roc_auc")).first()[0] > 0.9


def test_trees_of_distinct_vectors_equal_those_of_rows(spark):
    from plumbline.training.benchmark import _with_numbers

    i = F.col("id")
    rows = spark.range(900).select(
        F.array((i * 7 % 12).cast("double"), (i * 5 % 9).cast("double")).alias("x"),
        ((F.xxhash64("id") % 10 + i * 7 % 12) > 6).cast("double").alias("label"))
    from pyspark.ml.functions import array_to_vector

    rows = rows.select(array_to_vector("x").alias("features"), "label")
    weights, settings = {0.0: 0.7, 1.0: 1.9}, {"max_depth": 12, "min_leaf": 3}
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1, 1.9).otherwise(0.7))
    cells = rows.groupBy("features", "label").agg(F.count("*").alias("n"))
    a = create_estimator("decision_tree", 900.0, 1, settings).fit(weighted.coalesce(1))
    b = create_estimator("decision_tree", 900.0, 1, settings).fit(_with_numbers(cells, "decision_tree", weights, settings))
    assert a.numNodes == b.numNodes > 10
    found = a.transform(rows).select(F.col("probability").alias("p"), "features").distinct()
    other = {r["features"]: r["probability"][1] for r in b.transform(rows).collect()}
    assert all(other[r["features"]] == pytest.approx(r["p"][1]) for r in found.collect())


def test_forest_of_distinct_vectors_scores_as_mllib(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from plumbline.training.forest import cell_table, fits_tasks, forest_scores

    i = F.col("id")
    x = [(i * 7 % 80).cast("double"), (i * 5 % 9).cast("double"), (i % 2).cast("double"), F.lit(1.0)]
    noise = F.pmod(F.xxhash64("id"), F.lit(60))
    rows = spark.range(4000).select(
        array_to_vector(F.array(*x)).alias("features"), ((i * 7 % 80 + noise) > 90).cast("double").alias("label"),
        F.when(i * 7 % 80 + noise > 90, 2.0).otherwise(0.8).alias("weight"))
    settings = {"trees": 100, "max_depth": 8, "min_leaf": 2, "max_bins": 32}
    model = create_estimator("random_forest", 4000.0, 1, settings).fit(rows.coalesce(1))
    expected = {r["features"]: r["probability"][1] for r in model.transform(rows).collect()}
    train = rows.groupBy("features", "label").agg(F.count("*").alias("n"))
    cells = cell_table(train, rows.limit(50))
    assert fits_tasks(cells) and not fits_tasks(cell_table(train.withColumn("label", F.lit(None).cast("double")), rows))
    first, again = (
        {r["features"]: r["y_score"] for r in forest_scores(c, [0.8, 2.0], settings, 1).collect()}
        for c in (cells, cells.repartition(5))
    )
    assert first == again and first.keys() == expected.keys()
    ours = np.array([first[k] for k in expected])
    theirs = np.array(list(expected.values()))
    assert np.corrcoef(ours, theirs)[0, 1] > 0.98 and np.abs(ours - theirs).mean() < 0.04
    assert abs(ours.mean() - theirs.mean()) < 0.01


def test_a_forest_too_large_for_a_task_is_grown_by_mllib(sample, monkeypatch):
    from plumbline.training import benchmark as module
    from plumbline.training import forest

    monkeypatch.setattr(module, "MANY_ROWS", 5)
    monkeypatch.setattr(forest, "CELLS", 5)
    result = benchmark(sample, fixed_plan("d"), "isFraud", ["id"], 2, 1, models=["random_forest"], settings=QUICK)
    assert result.fold_metrics.count() == 2 and result.predictions.count() == 40


def test_a_benchmark_fits_distinct_rows_at_any_size(spark, sample, monkeypatch):
    """Few rows are put together too, after a sampler as well; each row has the score of its distinct row."""
    from plumbline.training import benchmark as module

    fitted = []
    plain = module.create_estimator

    def create(model, *args, **settings):
        made = plain(model, *args, **settings)

        class Counted:
            def fit(self, rows):
                fitted.append((model, rows.count()))
                return made.fit(rows)

        return Counted()

    monkeypatch.setattr(module, "create_estimator", create)
    rows = sample.withColumn("type", F.when(F.col("id") % 7 > 0, F.col("type")))
    many = rows.crossJoin(spark.range(6).toDF("copy")).withColumn("id", F.col("id") * 6 + F.col("copy")).drop("copy")
    assigned = many.select("id", "isFraud", F.lit(1).alias("repeat"), (F.col("id") % 2 + 1).cast("int").alias("fold"))
    plan = Plan("p", "d", 1, (
        Action("f", "impute_categorical", ("type",), {"strategy": "most_frequent"}),
        Action("h", "one_hot_encode", ("type",), {}),
        Action("r", "resample_classes", (), {"method": "random_undersampling", "random_seed": 1}, "logistic_regression"),
    ))
    result = benchmark(many, plan, "isFraud", ["id"], 2, 1, settings=QUICK, assigned=assigned)
    found = result.fold_results.collect()
    assert {(r["model"], r["status"]) for r in found} == {(m, "success") for m in QUICK}
    assert {(r["train_rows"], r["validation_rows"]) for r in found} == {(120, 120)}
    # 40 distinct rows, at most two copies of each for a tree; all 16 of the smaller class stay.
    sizes = {m: [n for k, n in fitted if k == m] for m, _ in fitted}
    assert sizes["decision_tree"] == [80, 80] and all(16 < n <= 40 for n in sizes["logistic_regression"])
    scores = result.predictions.withColumn("row", F.floor(F.col("id") / 6))
    assert scores.count() == 3 * 240 == scores.select("model", "id").distinct().count()
    assert scores.groupBy("model", "fold", "row").agg(F.count_distinct("y_score").alias("n")).where("n > 1").isEmpty()
