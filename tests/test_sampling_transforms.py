import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expressions import draw
from plumbline.operators import degrade as dg
from plumbline.operators import folds as fd
from plumbline.operators import neighbours as nb
from plumbline.operators import sampling as sp
from plumbline.operators import transforms as tr
from plumbline.operators.neighbours import nearest_neighbours, smote
from plumbline.operators.ordering import draw_cuts, rank_by_draw


@pytest.fixture
def labelled(spark):
    return spark.range(2000).select("id", (F.col("id") < 60).cast("int").alias("y"), (F.col("id") * 0.5).alias("x"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rank_by_draw_is_the_global_rank(labelled):
    drawn = labelled.withColumn("d", draw(1, "id"))
    ours = rank_by_draw(drawn, ["y"], "d", ["id"])
    plain = drawn.withColumn("rank", F.row_number().over(W.partitionBy("y").orderBy("d")))
    assert rows(ours.select("id", "rank")) == rows(plain.select("id", "rank"))


def test_cut_takes_exactly_n_and_refuses_shared_keys(spark, labelled):
    for n in (1, 7, 1999, 2000):
        cut = draw_cuts(labelled, {"s": draw(3, "id")}, {"s": n})["s"]
        assert labelled.where(draw(3, "id") <= cut).count() == n
    with pytest.raises(ValueError, match="Fewer rows"):
        draw_cuts(labelled, {"s": draw(3, "id")}, {"s": 2001})
    same = spark.createDataFrame([(1,)] * 10, "k int")
    with pytest.raises(ValueError, match="does not identify"):
        draw_cuts(same, {"s": draw(3, "k")}, {"s": 4})


def test_case_control_sample(spark, labelled):
    s = sp.case_control_sample(labelled, "y", ["id"], 10, 42)
    assert {r["y"]: r["count"] for r in s.groupBy("y").count().collect()} == {1: 60, 0: 600}
    again = sp.case_control_sample(labelled.repartition(13, "x"), "y", ["id"], 10, 42)
    assert rows(s) == rows(again)
    assert rows(s) != rows(sp.case_control_sample(labelled, "y", ["id"], 10, 43))
    with pytest.raises(ValueError, match="at least 1"):
        sp.case_control_sample(labelled, "y", ["id"], 0)
    with pytest.raises(ValueError, match="available"):
        sp.case_control_sample(labelled, "y", ["id"], 100)
    with pytest.raises(ValueError, match="no positive"):
        sp.case_control_sample(labelled.where("y = 0"), "y", ["id"])


def test_sample_plan_has_no_shuffle(labelled):
    plan = sp.case_control_sample(labelled, "y", ["id"], 2)._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString()


def test_folds_are_balanced_complete_and_repeatable(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(30)], "id int, y int")
    a = fd.stratified_folds(df, "y", ["id"], 3, 2, 42)
    sizes = a.groupBy("repeat", "fold", "y").count().collect()
    assert len(sizes) == 12 and all(r["count"] == 5 for r in sizes)
    assert a.groupBy("repeat").agg(F.count_distinct("id").alias("n")).where("n = 30").count() == 2
    assert rows(a) == rows(fd.stratified_folds(df.repartition(7), "y", ["id"], 3, 2, 42))
    first = {r["id"] for r in fd.validation_rows(a, 1, 1).collect()}
    rest = {r["id"] for r in fd.training_rows(a, 1, 1).collect()}
    assert not first & rest and len(first | rest) == 30
    few = spark.createDataFrame([(i, int(i > 3)) for i in range(6)], "id int, y int")
    with pytest.raises(ValueError, match="row per fold"):
        fd.stratified_folds(few, "y", ["id"], 3)
    with pytest.raises(ValueError, match="two classes"):
        fd.stratified_folds(few.withColumn("y", F.lit(1)), "y", ["id"], 2)
    with pytest.raises(ValueError):
        fd.stratified_folds(df, "y", ["id"], 1)


def test_fingerprint_binds_keys_to_targets(labelled):
    found = tuple(fd.target_fingerprint(labelled, "y", ["id"]).first())
    fd.check_same_target(labelled.repartition(5), "y", ["id"], found)
    moved = labelled.withColumn("y", (F.col("id") >= 1940).cast("int"))
    with pytest.raises(ValueError, match="do not match"):
        fd.check_same_target(moved, "y", ["id"], found)
    with pytest.raises(ValueError, match="number of rows"):
        fd.check_same_target(labelled.where("id > 0"), "y", ["id"], found)


def test_balancing(labelled):
    under = sp.undersample(labelled, "y", ["id"])
    assert {r["y"]: r["count"] for r in under.groupBy("y").count().collect()} == {1: 60, 0: 60}
    over = sp.oversample(labelled, "y", ["id"])
    assert {r["y"]: r["count"] for r in over.groupBy("y").count().collect()} == {1: 1940, 0: 1940}
    assert over.where("y = 1 and id >= 60").count() == 0
    assert rows(over) == rows(sp.oversample(labelled.repartition(9), "y", ["id"]))
    weights = {r["class"]: r["weight"] for r in sp.class_weights(labelled, "y").collect()}
    assert weights == {1: pytest.approx(2000 / 120), 0: pytest.approx(2000 / 3880)}


def test_degrade(spark):
    df = spark.createDataFrame(
        [(i, float(i), "PAYMENT" if i % 2 else "TRANSFER", i % 2) for i in range(1, 21)],
        "id long, amount double, type string, isFraud long",
    )
    rates = {"amount": 0.20, "type": 0.10}
    out = dg.degrade(df, rates, ["id"], 42, ["isFraud"])
    audit = {r["column"]: r["affected_rows"] for r in dg.degradation_audit(df, rates, ["id"]).collect()}
    assert audit == {"amount": 4, "type": 2}
    nulls = out.select(F.count_if(F.col("amount").isNull()), F.count_if(F.col("type").isNull())).first()
    assert tuple(nulls) == (4, 2)
    assert rows(out) == rows(dg.degrade(df.repartition(6), rates, ["id"], 42))
    assert df.where("amount is null").count() == 0
    for bad, message in (({"isFraud": 0.1}, "Protected"), ({"amount": 0.0}, "between"),
                         ({"amount": 1.0}, "between"), ({}, "at least one"), ({"z": 0.1}, "missing")):
        with pytest.raises(ValueError, match=message):
            dg.degrade(df, bad, ["id"], 42, ["isFraud"])
    with pytest.raises(ValueError, match="empty"):
        dg.degrade(df.limit(0), rates, ["id"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    log = dg.corruption_log(df, rates, ["id"])
    assert log.count() == 6
    fixed = tr.impute_categorical(out, ["type"], "most_frequent")
    done = {r["column"]: r for r in dg.repair_accuracy(log, fixed, ["id"]).collect()}
    assert done["type"]["repaired_cells"] == 2 and done["amount"]["repaired_cells"] == 0


def test_affected_rows_rounds_half_to_even():
    assert dg.affected_rows(72149, 0.05) == 3607
    assert dg.affected_rows(10, 0.25) == 2
    assert dg.affected_rows(3, 0.01) == 1


def test_imputation_learns_on_training_rows(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (100.0, "a"), (2.0, "b")], "x double, c string")
    df = spark.createDataFrame([(None, None), (float("nan"), "z")], "x double, c string")
    filled = tr.impute_numeric(df, ["x"], "median", train).collect()
    assert [r["x"] for r in filled] == [2.5, 2.5]
    assert tr.impute_numeric(df, ["x"], "mean", train).first()["x"] == 26.5
    assert tr.impute_categorical(df, ["c"], "most_frequent", train=train).first()["c"] == "a"
    assert tr.impute_categorical(df, ["c"], "constant", "k").first()["c"] == "k"
    with pytest.raises(ValueError, match="no value"):
        tr.impute_categorical(df.where("c is null"), ["c"], "most_frequent")
    with pytest.raises(ValueError):
        tr.impute_numeric(df, ["x"], "magic", train)


def test_scaling(spark):
    x = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(float(v), 5.0) for v in x], "x double, k double")
    std = [r["x"] for r in tr.scale_numeric(df, ["x", "k"], "standard").collect()]
    assert std == pytest.approx(list((x - x.mean()) / x.std()))
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    out = tr.scale_numeric(df, ["x", "k"], "robust").collect()
    assert [r["x"] for r in out] == pytest.approx(list((x - q2) / (q3 - q1)))
    assert {r["k"] for r in out} == {0.0}


@pytest.mark.parametrize("bad", [-0.1, None, float("nan"), float("inf")])
def test_log_transform_refuses(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,)], "x double")
    assert tr.log_transform(df.limit(1), ["x"]).first()["x"] == pytest.approx(math.log(2))
    with pytest.raises(Exception, match="non-negative"):
        tr.log_transform(df, ["x"]).collect()


def test_one_hot(spark):
    train = spark.createDataFrame([("a",), (None,)], "c string")
    out = tr.one_hot_encode(spark.createDataFrame([("a",), ("new",), (None,)], "c string"), ["c"], train)
    assert out.columns == ["c=__NULL__", "c=a"]
    assert sorted(map(tuple, out.collect())) == [(0, 0), (0, 1), (1, 0)]


def test_fold_statistics_equal_direct_ones(labelled):
    folds = fd.stratified_folds(labelled, "y", ["id"], 4, 2)
    data = labelled.join(folds.drop("y"), "id")
    for r in tr.fold_statistics(data, ["x"], 4).collect():
        x = np.array([q["x"] for q in fd.training_rows(data, r["repeat"], r["fold"]).collect()])
        assert r["train_rows"] == len(x)
        assert r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std())
        assert [r["q25"], r["median"], r["q75"]] == pytest.approx(list(np.quantile(x, [.25, .5, .75])))


def brute_force(points, k):
    found = {}
    for i, a in points.items():
        gaps = sorted((float(np.sqrt(((a - b) ** 2).sum())), j) for j, b in points.items() if j != i)
        found[i] = [(j, round(g, 9)) for g, j in gaps[:k]]
    return found


def unit_vectors(n, dims=8, centres=20, spread=0.05):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(centres, dims))
    x = middle[rng.integers(0, centres, n)] / np.sqrt(dims) + rng.normal(scale=spread, size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("most", [2048, 10])
def test_neighbours_of_unit_vectors(spark, monkeypatch, most):
    """All have one norm; still few blocks are asked for each, and block sizes are bounded."""

    monkeypatch.setattr(nb, "MOST_PIVOTS", most)
    kept = []
    plain = nb.durable
    monkeypatch.setattr(nb, "durable", lambda d: kept.append(plain(d)) or kept[-1])
    points = dict(enumerate(unit_vectors(1500)))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in points.items()], "id long, v array<double>").repartition(4)
    near = nearest_neighbours(df, "id", "v", 4, cell_rows=25)
    found = {}
    for r in near.orderBy("id", "place").collect():
        found.setdefault(r["id"], []).append((r["neighbour"], round(r["distance"], 9)))
    assert found == brute_force(points, 4)
    sizes = {r["cell"]: r["count"] for r in kept[0].groupBy("cell").count().collect()}
    blocks = sum(-(-n // 25) for n in sizes.values())
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    pivots = np.unique(np.array([r["x"] for r in kept[0].select("x", draw(0, "id").alias("w")).orderBy("w").limit(
        min(most, 60)).collect()]), axis=0)
    ranges = np.array([[np.inf, -np.inf]] * len(pivots))
    for r in kept[0].groupBy("cell").agg(F.min("d").alias("a"), F.max("d").alias("b")).collect():
        ranges[r["cell"]] = r["a"], r["b"]
    asked = 0
    for r in kept[1].collect():
        low, _ = nb._lower_bounds(np.array([r["x"]]), np.array([r["cell"]]), pivots, ranges)
        asked += sum(-(-sizes[c] // 25) for c in np.flatnonzero(low[0] <= r["radius"]) if c in sizes)
    assert asked / len(points) < 0.45 * blocks


def test_neighbours_of_odd_rows(spark):
    bad = [(100, None, 1.0), (101, float("nan"), 1.0), (102, float("inf"), 1.0)]
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), *bad], "id long, a double, b double")
    assert rows(nearest_neighbours(df, "id", ["a", "b"], 3)) == [(1, 1, 2, 5.0), (2, 1, 1, 5.0)]
    none = nearest_neighbours(df.limit(0), "id", ["a", "b"])
    assert none.columns == ["id", "place", "neighbour", "distance"] and none.count() == 0


@pytest.mark.parametrize("copies", [0, 100])
def test_neighbours_equal_brute_force_across_cells(spark, monkeypatch, copies):
    """Small cells force many pivots, salts and probe parts; a third of the rows are copies."""

    monkeypatch.setattr(nb, "_PROBES_PER_CELL_ROW", 1)
    rng = np.random.default_rng(3)
    values = [rng.normal(3, 2, 3).round(2) for _ in range(200)] + [np.array([1.0, 1.0, 1.0])] * copies
    points = dict(enumerate(values))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in points.items()], "id long, a double, b double, c double")
    near = nearest_neighbours(df, "id", ["a", "b", "c"], 3, cell_rows=16).orderBy("id", "place")
    found = {}
    for r in near.collect():
        found.setdefault(r["id"], []).append((r["neighbour"], round(r["distance"], 9)))
    assert found == brute_force(points, 3)


def test_smote(spark, labelled):
    out = smote(labelled, "y", ["id"])
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {1: 1940, 0: 1940}
    made = out.where("id is null")
    assert made.count() == 1880
    low, high = made.agg(F.min("x"), F.max("x")).first()
    assert low >= 0 and high <= 29.5
    again = smote(labelled.repartition(11), "y", ["id"]).where("id is null")
    assert rows(made.select(F.round("x", 9))) == rows(again.select(F.round("x", 9)))
    with pytest.raises(ValueError, match="more than"):
        smote(labelled.where("id < 3 or y = 0"), "y", ["id"])


@pytest.mark.parametrize("bounded", [True, False])
def test_few_distances_are_computed_one_by_one(monkeypatch, bounded):
    draw = np.random.default_rng(3)
    x = np.round(draw.normal(size=(900, 64)), 1) * 1e3
    x[500:520] = x[7]
    ids = draw.permutation(900)
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    radius = np.sort(gaps, axis=1)[:, 4] if bounded else np.full(900, np.inf)
    rows = pd.DataFrame({"id": ids, "x": list(x)})
    pairs = []
    plain = nb._pair_distances
    monkeypatch.setattr(nb, "_pair_distances", lambda a, at, b, to: pairs.append(len(at)) or plain(a, at, b, to))
    near = nb._nearest(rows.assign(radius=radius), rows, 5)
    want = {ids[i]: [(ids[j], gaps[i, j]) for j in np.lexsort((ids, gaps[i]))[:5]] for i in range(900)}
    got = {i: list(zip(g["neighbour"], g["distance"], strict=True)) for i, g in near.groupby("id")}
    assert got == want
    assert sum(pairs) < 900 * 10


def test_many_dimensions_and_several_cells(spark, monkeypatch):
    monkeypatch.setattr(nb, "LARGE_CELL_ROWS", 64)
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 20))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    near = nb.nearest_neighbours(df, "id", "v", 3).orderBy("id", "place").collect()
    assert [(r["id"], r["neighbour"]) for r in near] == [
        (i, j) for i in range(400) for j in np.argsort(gaps[i], kind="stable")[:3]]
