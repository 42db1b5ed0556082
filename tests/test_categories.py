import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import categories as ct


def order(values):
    return sorted(values, key=lambda v: "" if v is None else hashlib.md5(v.encode()).hexdigest())


@pytest.fixture
def cells(spark):
    """A category with a third of all rows, a missing one, many single ones and clashing columns."""
    draw = random.Random(6)
    rows = [(k, draw.choice(["hot", "hot", "hot", None, f"v{k}", "", "é", "#1"]), "x" if k % 2 else None, k) for k in range(600)]
    return spark.createDataFrame(rows, "id long, `a.b` string, c string, rows int"), rows


@pytest.mark.parametrize("most", [0, 100_000])
def test_indices_and_vectors(cells, monkeypatch, most):
    monkeypatch.setattr(ct, "BROADCAST_ROWS", most)
    monkeypatch.setattr(ct, "HEAVY_SHARE", 0.05)
    df, rows = cells
    learned = df.where("id < 400")
    table = ct.category_table(learned, ["a.b", "c"]).cache()
    sizes = ct.category_sizes(table, ["a.b", "c"])
    first = order({r[1] for r in rows[:400]})
    second = order({r[2] for r in rows[:400]})
    assert sizes == {"a.b": len(first), "c": len(second)}
    got = {(r["column"], r["value"]): (r["index"], r["rows"]) for r in table.collect()}
    assert got == {
        (c, v): (i, sum(r[k] == v for r in rows[:400]))
        for k, c, values in ((1, "a.b", first), (2, "c", second))
        for i, v in enumerate(values)
    }
    want = {r[0]: (first.index(r[1]) if r[1] in first else None, second.index(r[2])) for r in rows}
    indexed = ct.with_indices(df, table, sizes)
    assert indexed.columns == df.columns
    assert {r["id"]: (r["a.b"], r["c"]) for r in indexed.collect()} == want
    for r in ct.as_vectors(indexed, sizes).collect():
        a, c = want[r["id"]]
        assert (r["a.b"].size, r["a.b"].indices.tolist()) == (len(first), [] if a is None else [a])
        assert (r["c"].size, r["c"].indices.tolist(), r["c"].values.tolist()) == (len(second), [c], [1.0])


def test_fifty_thousand_categories(spark):
    df = spark.range(50_000).select("id", F.col("id").cast("string").alias("c"))
    out = ct.one_hot_sparse(df, ["c"]).select("id", F.unwrap_udt("c").alias("v"))
    sizes = out.select("v.size", F.size("v.indices"), F.element_at("v.indices", 1).alias("i"))
    assert sizes.distinct().count() == 50_000
    assert sizes.agg(F.min("size"), F.max("size"), F.min("i"), F.max("i")).first() == (50_000, 50_000, 0, 49_999)


def test_nothing_learned(cells):
    df, _ = cells
    out = ct.one_hot_sparse(df, ["c"], df.limit(0)).select("c").distinct().collect()
    assert [(r["c"].size, r["c"].toArray().tolist()) for r in out] == [(1, [0.0])]
    assert ct.one_hot_sparse(df.limit(0), ["c"]).count() == 0


def test_dense_columns_have_no_most(spark):
    from plumbline.operators.transforms import learn_categories

    df = spark.range(10_001).select(F.col("id").cast("string").alias("c"))
    assert len(learn_categories(df, ["c"])["c"]) == 10_001


def test_long_vectors_carry_no_names(spark):
    """A name for each position would make the schema, on the driver, grow with the categories."""
    df = spark.range(30_000).select("id", F.col("id").cast("string").alias("c"), F.lit("x").alias("d"))
    out = ct.assembled(ct.one_hot_sparse(df, ["c", "d"]), ["c", "d"], "v")
    assert out.schema["c"].metadata == {"ml_attr": {"num_attrs": 30_000}}
    assert len(out.schema.json()) < 2_000
    v = out.select(F.unwrap_udt("v").alias("v")).select("v.size", "v.indices", "v.values").collect()
    assert {r["size"] for r in v} == {30_001} and {tuple(r["values"]) for r in v} == {(1.0, 1.0)}
    assert sorted(r["indices"][0] for r in v) == list(range(30_000)) and {r["indices"][1] for r in v} == {30_000}


def test_plans_of_long_vectors_hold_no_positions(spark):
    """A list of all positions in the plan would grow with the categories, on the driver and in each task."""

    def plan_bytes(n):
        df = spark.range(n).select("id", F.col("id").cast("string").alias("c"), F.lit("x").alias("d"))
        out = ct.assembled(ct.one_hot_sparse(df, ["c", "d"]), ["c", "d"], "v")
        return len(spark._jvm.org.apache.spark.util.Utils.serialize(out._jdf.queryExecution().executedPlan()))

    assert abs(plan_bytes(40_000) - plan_bytes(20_000)) < 10_000


def test_dense_and_sparse_cells_assemble_alike(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(ct, "NAMED", 0)
    rows = [(Vectors.dense(0.0, 2.5, -1.0), 4.0), (Vectors.sparse(3, [1], [2.5]), 0.0), (Vectors.sparse(3, [], []), 1.0)]
    df = spark.createDataFrame(rows, ["v", "x"])
    df = df.withMetadata("v", {"ml_attr": {"num_attrs": 3}})
    got = [r["out"] for r in ct.assembled(df, ["x", "v"], "out").collect()]
    assert got == [Vectors.sparse(4, [0, 2, 3], [4.0, 2.5, -1.0]), Vectors.sparse(4, [2], [2.5]), Vectors.sparse(4, [0], [1.0])]
    empty = df.select(F.when(F.col("x") > 1, F.col("v")).alias("v", metadata={"ml_attr": {"num_attrs": 3}}))
    with pytest.raises(Exception, match="Missing value in column v"):
        ct.assembled(empty, ["v"], "out").collect()


def test_long_vectors_equal_short_ones(cells, monkeypatch):
    df, _ = cells
    df = df.withColumn("half", F.col("rows") % 3 / 2.0)
    learned = df.where("id < 400")
    names = ["half", "ab", "c", "rows"]

    def whole():
        encoded = ct.one_hot_sparse(df, ["a.b", "c"], learned).withColumnRenamed("a.b", "ab")
        return {r["id"]: r["v"].toArray().tolist() for r in ct.assembled(encoded, names, "v").collect()}

    short = whole()
    monkeypatch.setattr(ct, "NAMED", 3)
    assert whole() == short and len(short) == 600
    monkeypatch.setattr(ct, "NAMED", 0)
    assert whole() == short


def test_long_vectors_refuse_missing_numbers(spark, monkeypatch):
    monkeypatch.setattr(ct, "NAMED", 0)
    for x in (None, float("nan")):
        df = spark.createDataFrame([(1.0, 2.0), (3.0, x)], "a double, b double")
        with pytest.raises(Exception, match="Missing value in column b"):
            ct.assembled(df, ["a", "b"], "v").collect()
