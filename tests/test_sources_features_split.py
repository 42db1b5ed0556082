import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators.features import LEAKING_COLUMNS, add_features, prepare_features
from plumbline.operators.split import split_summary, split_temporally, temporal_cutoff
from plumbline.sources import tables as src

ROWS = [
    (1, "TRANSFER", 0.0, "C1", 10.0, 10.0, "M1", 0.0, 0.0, 0, 0),
    (25, "CASH_OUT", 99.0, "C2", 20.0, 0.0, "C3", 5.0, 104.0, 1, 0),
]


def source_table(spark):
    return spark.createDataFrame(ROWS, src.TRANSACTION_SCHEMA)


def test_features_and_dropped_columns(spark):
    out = prepare_features(source_table(spark)).orderBy("step")
    rows = out.collect()
    assert [r["hour"] for r in rows] == [0, 0]
    assert [r["day"] for r in rows] == [0, 1]
    assert [r["is_transfer"] for r in rows] == [1, 0]
    assert [r["is_cash_out"] for r in rows] == [0, 1]
    assert [r["is_merchant_destination"] for r in rows] == [1, 0]
    assert rows[1]["log_amount"] == pytest.approx(math.log(100))
    assert not set(LEAKING_COLUMNS) & set(out.columns)
    assert "isFraud" in out.columns
    assert dict(out.dtypes)["hour"] == "smallint"
    assert dict(out.dtypes)["is_transfer"] == "tinyint"


def test_feature_types_below_origin_use_floor(spark):
    df = spark.createDataFrame([(0, "A", 1.0, "C")], "step long, type string, amount double, nameDest string")
    row = add_features(df).first()
    assert (row["hour"], row["day"]) == (23, -1)


def test_feature_input_is_checked(spark):
    with pytest.raises(ValueError, match="amount, nameDest"):
        add_features(spark.createDataFrame([(1, "A")], "step long, type string"))


def test_scan_refuses_unknown_suffix_and_missing_file(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported"):
        src.scan_table(spark, str(tmp_path / "a.xlsx"))
    for name in ("a.csv", "a.parquet", "a.pq"):
        with pytest.raises(FileNotFoundError):
            src.scan_table(spark, str(tmp_path / name))


def test_required_columns_are_listed_sorted(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    source_table(spark).drop("type", "amount").write.parquet(path)
    with pytest.raises(ValueError, match="amount, type"):
        src.load_table(spark, path)


def test_csv_without_schema_keeps_dates_as_text(spark, tmp_path):
    path = str(tmp_path / "d.csv")
    (tmp_path / "d.csv").write_text("a,b,c\n1,2024-01-01,2024-01-01 10:00:00\n")
    types = dict(src.scan_table(spark, path).dtypes)
    assert types["a"] == "int" and types["b"] == "string" and types["c"] == "string"


def test_convert_csv(spark, tmp_path):
    csv, parquet = str(tmp_path / "in.csv"), str(tmp_path / "out.parquet")
    src.write_csv(source_table(spark), csv)
    with pytest.raises(ValueError, match="differ"):
        src.convert_csv(spark, csv, csv)
    back = src.convert_csv(spark, csv, parquet)
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    assert any(p.name.endswith(".zstd.parquet") for p in (tmp_path / "out.parquet").iterdir())


def test_csv_schema_follows_the_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,extra,a\n2.5,z,1\n")
    schema = "a long, b double"
    from pyspark.sql.types import StructType

    row = src.scan_table(spark, str(tmp_path / "x.csv"), StructType.fromDDL(schema)).first()
    assert (row["a"], row["b"], row["extra"]) == (1, 2.5, "z")


def test_written_splits_prune(spark, tmp_path):
    rows = [(s, "PAYMENT", 1.0, "C", 0.0, 0.0, "M", 0.0, 0.0, s % 2, 0) for s in range(1, 11)]
    df = spark.createDataFrame(rows, src.TRANSACTION_SCHEMA)
    path = str(tmp_path / "splits")
    assert src.write_temporal_splits(df, path) == 9
    dev = src.read_split(spark, path)
    assert dev.count() == 8 and src.read_split(spark, path, "temporal_test").count() == 2
    plan = dev._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "development" in plan
    with pytest.raises(ValueError):
        src.read_split(spark, path, "other")


def test_temporal_split(spark):
    df = spark.createDataFrame(
        [(s, 0) for s in (1, 1, 2, 2, 3, 3, 4, 4, 5, 5)] + [(None, 0)], "step long, isFraud long"
    )
    dev, held = split_temporally(df, "step", 0.40)
    assert {r["step"] for r in dev.collect()} == {1, 2, 3}
    assert {r["step"] for r in held.collect()} == {4, 5}
    skewed = spark.createDataFrame([(1,)] * 100 + [(s,) for s in (2, 3, 4, 5)], "step long")
    assert temporal_cutoff(skewed) == 5
    for bad in (0.0, 1.0, -0.1, 1.1):
        with pytest.raises(ValueError):
            temporal_cutoff(df, "step", bad)
    with pytest.raises(ValueError, match="two distinct"):
        temporal_cutoff(spark.createDataFrame([(1,)], "step long"))
    with pytest.raises(ValueError):
        temporal_cutoff(df, "absent")
    total = split_summary(df, "step", "isFraud", 4).agg(F.sum("rows")).first()[0]
    assert total == 10


@pytest.mark.parametrize("kind, values", [
    ("double", [-5.5, -0.25, 0.0, 0.5, 1e12]),
    ("date", ["1969-12-30", "1970-01-01", "2024-02-29", "2024-03-01", "2024-03-02"]),
    ("timestamp", ["1969-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-01 00:00:01",
                   "2024-01-01 00:00:01.5", "2024-01-02 00:00:00"]),
    ("timestamp_ntz", ["1969-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-01 00:00:01",
                       "2024-01-01 00:00:01.5", "2024-01-02 00:00:00"]),
    ("string", ["a", "b", "c", "d", "e"]),
])
@pytest.mark.parametrize("fraction, place", [(0.2, 4), (0.4, 3), (0.5, 2), (0.8, 1), (0.99, 1)])
def test_cutoff_of_any_ordered_type(spark, kind, values, fraction, place):
    rows = [(v,) for v in values * 3] + [(None,)]
    base = "double" if kind == "double" else "string"
    df = spark.createDataFrame(rows, f"t {base}").select(F.col("t").cast(kind).alias("t"))
    expected = sorted(r["t"] for r in df.where("t is not null").distinct().collect())[place]
    assert temporal_cutoff(df.repartition(3), "t", fraction) == expected


def test_strict_json(spark, tmp_path):
    df = spark.createDataFrame(
        [(float("nan"), [1.0, float("inf")], {"k": float("-inf")}, (2.0, float("nan")))],
        "a double, b array<double>, c map<string,double>, d struct<x:double,y:double>",
    )
    src.write_json(df.coalesce(1), str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("*.json")).read_text()
    assert json.loads(text, parse_constant=lambda c: pytest.fail(c)) == {
        "a": None, "b": [1.0, None], "c": {"k": None}, "d": {"x": 2.0, "y": None},
    }
    assert src.read_json(spark, str(tmp_path / "r")).first()["b"] == [1.0, None]
