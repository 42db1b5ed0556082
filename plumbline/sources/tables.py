"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.expressions import col, finite_or_null, require_columns
from plumbline.operators.features import prepare_features
from plumbline.operators.split import DEVELOPMENT, HOLDOUT, split_label, temporal_cutoff

# The source table of transactions.
TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrig", T.DoubleType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
        T.StructField("newbalanceDest", T.DoubleType()),
        T.StructField("isFraud", T.LongType()),
        T.StructField("isFlaggedFraud", T.LongType()),
    ]
)

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def scan_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Lazy table from a CSV or Parquet path, by suffix. CSV dates stay text.

    With a schema the CSV is not read to infer types, and columns are matched by header name.
    """
    suffix = PurePosixPath(str(path)).suffix.lower()
    if suffix not in (".csv", ".parquet", ".pq"):
        raise ValueError(f"Unsupported table format '{suffix}': {path}")
    try:
        if suffix != ".csv":
            return spark.read.parquet(str(path))
        reader = spark.read.option("header", True)
        if schema is None:
            guessed = reader.option("inferSchema", True).csv(str(path)).schema
            as_text = [
                T.StructField(f.name, T.StringType() if isinstance(f.dataType, _DATES) else f.dataType)
                for f in guessed.fields
            ]
            return spark.read.option("header", True).schema(T.StructType(as_text)).csv(str(path))
        header = reader.csv(str(path))
        require_columns(header, schema.fieldNames(), "CSV file")
        kinds = {f.name: f.dataType for f in schema.fields}
        in_file = T.StructType(
            [T.StructField(c, kinds.get(c, T.StringType())) for c in header.columns]
        )
        return reader.schema(in_file).csv(str(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Table not found: {path}") from error
        raise


def load_table(
    spark: SparkSession,
    path: str,
    required: Iterable[str] = TRANSACTION_SCHEMA.fieldNames(),
    schema: T.StructType | None = None,
) -> DataFrame:
    """Scan and check column names. Stays lazy; extra columns are kept."""
    df = scan_table(spark, path, schema)
    require_columns(df, required)
    return df


def convert_csv(
    spark: SparkSession,
    source: str,
    destination: str,
    schema: T.StructType | None = TRANSACTION_SCHEMA,
    required: Iterable[str] = TRANSACTION_SCHEMA.fieldNames(),
    sort_by: str | None = "step",
) -> DataFrame:
    """CSV to zstd Parquet in one pass, without a shuffle.

    Sorting inside each output file gives row groups narrow time ranges to skip by.
    """
    if str(source).rstrip("/") == str(destination).rstrip("/"):
        raise ValueError("Source and destination must differ")
    df = load_table(spark, source, required, schema)
    if sort_by:
        df = df.sortWithinPartitions(sort_by)
    write_parquet(df, destination)
    return spark.read.parquet(str(destination))


def write_parquet(
    df: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "errorifexists"
) -> None:
    (
        df.write.mode(mode)
        .option("compression", "zstd")
        .partitionBy(*partition_by)
        .parquet(str(path))
    )


def write_temporal_splits(
    df: DataFrame,
    path: str,
    time: str = "step",
    test_fraction: float = 0.20,
    mode: str = "errorifexists",
) -> object:
    """Derive features and write both sides in one pass, one directory per side.

    Readers of development data prune the holdout directory and never open its files.
    """
    require_columns(df, TRANSACTION_SCHEMA.fieldNames())
    cutoff = temporal_cutoff(df, time, test_fraction)
    rows = prepare_features(df, step=time).withColumn("split", split_label(time, cutoff))
    write_parquet(rows.where(F.col("split").isNotNull()), path, ["split"], mode)
    return cutoff


def read_split(spark: SparkSession, path: str, split: str = DEVELOPMENT) -> DataFrame:
    if split not in (DEVELOPMENT, HOLDOUT):
        raise ValueError(f"Unknown split: {split}")
    return spark.read.parquet(str(path)).where(F.col("split") == split).drop("split")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(str(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(str(path))


def strict_json(df: DataFrame) -> DataFrame:
    """Replace NaN and the infinities by null at any depth."""

    def clean(value, dtype: T.DataType):
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return finite_or_null(value)
        if isinstance(dtype, T.StructType):
            fields = [clean(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, lambda x: clean(x, dtype.elementType))
        if isinstance(dtype, T.MapType):
            return F.transform_values(value, lambda _, x: clean(x, dtype.valueType))
        return value

    return df.select(*[clean(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Strict JSON lines; null fields are written. The commit protocol makes it all or nothing."""
    strict_json(df).write.mode(mode).option("ignoreNullFields", False).json(str(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(str(path))
