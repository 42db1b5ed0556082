import datetime
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expressions import magnitude_bucket
from plumbline.operators import ordering as od
from plumbline.operators.folds import other_folds
from plumbline.operators.split import temporal_cutoff

DAY = 1_704_067_200_000_000


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(od, "FEW", 32)
    monkeypatch.setattr(od, "PARTS", 8)


def crowded():
    """A day of microseconds, most of them within a millisecond, and a value that many rows have."""
    draw = random.Random(3)
    near = [DAY + draw.randrange(1000) for _ in range(900)]
    return near + [DAY + draw.randrange(86_400_000_000) for _ in range(300)] + [DAY + 500] * 400


def levels_of(monkeypatch):
    seen = []
    plain = od._levels

    def watched(known, stable):
        for level in plain(known, stable):
            seen.append(level)
            yield level

    monkeypatch.setattr(od, "_levels", watched)
    return seen


def test_crowded_values_are_cut_until_few_are_left(spark, few, monkeypatch):
    values = crowded()
    df = spark.createDataFrame([(v, float(k)) for k, v in enumerate(values)], "t long, x double").repartition(5)
    seen = levels_of(monkeypatch)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    got = {(r["column"], r["probability"]): r["quantile"] for r in od.exact_quantiles(df, ["t", "x"], probs).collect()}
    for p in probs:
        assert got["t", p] == pytest.approx(np.quantile(np.array(values, float), p), rel=0, abs=0.01)
        assert got["x", p] == pytest.approx(np.quantile(np.arange(len(values)), p))
    # The largest bucket that a task sorts, though a first bucket holds most rows.
    assert max(r["_count"] for s in seen for r in s.crowded) > 1000
    assert len(seen) > 2 and all(r["_count"] <= 32 for s in seen for r in s.few)
    sizes = df.groupBy(magnitude_bucket(F.col("t"))).count()
    assert sizes.agg(F.max("count")).first()[0] > 1000


def test_crowded_values_of_folds(spark, few):
    draw = random.Random(4)
    rows = [(v, draw.randrange(1, 4), draw.randrange(1, 3)) for v in crowded()]
    df = spark.createDataFrame(rows, "t long, fold int, repeat int")
    got = od.exact_quantiles(df, ["t"], [0.25, 0.5], ["repeat", "fold"], other_folds(3), ["repeat"]).collect()
    assert len(got) == 12
    for r in got:
        own = [v for v, fold, repeat in rows if fold != r["fold"] and repeat == r["repeat"]]
        assert r["quantile"] == pytest.approx(np.quantile(np.array(own, float), r["probability"]), abs=0.01)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_of_crowded_values(spark, few, monkeypatch, descending):
    values = sorted({*crowded(), 0, -5, 2**62, 2**62 + 1, *range(2**60, 2**60 + 90)})
    df = spark.createDataFrame(
        [(g, v, k + 1) for g in ("a", "b", None) for k, v in enumerate(values[:: 1 if g == "a" else 7])],
        "g string, t long, n long",
    ).repartition(4)
    sizes = []
    plain = od.durable
    monkeypatch.setattr(od, "durable", lambda d: sizes.append(plain(d)) or sizes[-1])
    got = od.running_totals(df, ["g"], "t", ["n"], descending=descending)
    order = F.desc("t") if descending else F.asc("t")
    window = W.partitionBy("g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    want = df.withColumn("n_before", F.coalesce(F.sum("n").over(window), F.lit(0)))
    key = lambda r: (r["g"] or "", r["t"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert sizes[0].agg(F.max("_n")).first()[0] > 500 and sizes[-1].agg(F.max("_n")).first()[0] <= 32


def texts():
    day = datetime.datetime(2024, 1, 1)
    return [(day + datetime.timedelta(microseconds=v - DAY)).strftime("%Y-%m-%d %H:%M:%S.%f") for v in set(crowded())]


@pytest.mark.parametrize("kind, values", [
    ("long", [*set(crowded()), -7, 2**62, 2**62 + 1]),
    ("double", [*map(float, set(crowded())), float("-inf"), float("nan"), -0.5, 1e-300]),
    ("double", [float(k) / 7 for k in range(300)]),
    ("string", [*texts(), "", "2024", "2024-01-01\0", "2024-01-01\0\0", "é", "zz"]),
    ("string", [f"{'x' * 50}{k:04d}" for k in range(300)]),
    ("date", [datetime.date(1960, 1, 1) + datetime.timedelta(days=k * k % 9000) for k in range(300)]),
    ("timestamp_ntz", [datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=k**3) for k in range(300)]),
    ("timestamp", [datetime.datetime(1969, 1, 1) + datetime.timedelta(microseconds=k**4) for k in range(300)]),
])
def test_value_at_any_place(spark, few, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").distinct().repartition(3).cache()
    ordered = [r["v"] for r in df.orderBy("v").collect()]
    for place in sorted({0, 1, 40, len(ordered) // 2, 2 * len(ordered) // 3, len(ordered) - 2, len(ordered) - 1}):
        assert repr(od.value_at(df, "v", place)) == repr(ordered[place]), place
    with pytest.raises(ValueError):
        od.value_at(df, "v", len(ordered))


def test_cutoff_of_crowded_text(spark, few):
    values = sorted(texts())
    df = spark.createDataFrame([(v,) for v in values * 2 + [None]], "t string")
    assert temporal_cutoff(df, "t", 0.25) == values[len(values) - -(-len(values) // 4)]
