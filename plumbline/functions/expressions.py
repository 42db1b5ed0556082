"""Column expressions shared by the operators. Nothing here starts a job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)
FLOATING_TYPES = (T.FloatType, T.DoubleType)

# Buckets per power of two in ``magnitude_bucket``.
_PER_OCTAVE = 4096
# Larger than 1074 * _PER_OCTAVE, the bucket distance from 1.0 to the smallest double.
_BUCKET_SHIFT = 4_500_000
_BUCKET_TOP = 10_000_000

# Text above this many bytes is compared by digest instead of being shuffled whole.
_INLINE_BYTES = 64


def col(value: str | Column) -> Column:
    """Column named exactly ``value``; dots in the name are part of the name."""
    return value if isinstance(value, Column) else F.col("`" + value.replace("`", "``") + "`")


def columns_of(df: DataFrame, *types: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, *NUMERIC_TYPES)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator of one row, which the optimizer cannot inline.

    For costly expressions that many later ones use: a plain projection would be merged into
    its consumers and evaluated once per use.
    """
    cells = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(cells)))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over several tasks per core, for work that takes long for few bytes.

    Files are split by bytes, so a million short rows may be one task.
    """
    spark = df.sparkSession
    partitions = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(partitions)


def require_columns(df: DataFrame, required: Iterable[str], what: str = "Table") -> None:
    """Raise with the sorted missing names. Reads the schema only."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")


def flag_equals(column: str | Column, value: object) -> Column:
    return (col(column) == F.lit(value)).cast("byte")


def flag_prefix(column: str | Column, prefix: str) -> Column:
    return col(column).startswith(prefix).cast("byte")


def at_least(score: str | Column, threshold: float) -> Column:
    """1 where the score reaches the threshold, else 0."""
    if threshold < 0.0 or threshold > 1.0:
        raise ValueError(f"Scores are shares, so no threshold can be {threshold}")
    return (col(score) >= F.lit(threshold)).cast("int")


def to_number(column: str | Column) -> Column:
    """Double value of the column; text that is no number becomes null."""
    return col(column).try_cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating column."""
    floats = columns_of(df, *FLOATING_TYPES)
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def finite_or_null(value: Column) -> Column:
    """Null for NaN and the infinities, which strict JSON cannot hold."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def draw(seed: int, *parts: str | int | Column) -> Column:
    """Reproducible pseudo-random text for a row, from a seed and its key columns.

    The draw depends on the key alone, so membership of a sample does not change with
    partitioning, retries or the order of rows. A string part names a column.
    """
    pieces = [F.lit(str(seed))]
    for part in parts:
        pieces.append(F.lit(str(part)) if isinstance(part, int) else col(part).cast("string"))
    return F.md5(F.concat_ws("|", *pieces))


DRAWS = 2**60


def draw_number(drawn: Column) -> Column:
    """The first 60 bits of a draw as a number from 0 to DRAWS - 1."""
    return F.conv(F.substring(drawn, 1, 15), 16, 10).cast("long")


def magnitude_bucket(value: Column) -> Column:
    """Long that never decreases as the value grows, with 4096 steps per power of two.

    Rows of one bucket differ by less than 0.02 %, so buckets cut heavy-tailed columns
    into pieces without looking at the data first.
    """
    x = value.cast("double")
    step = F.floor(F.log2(F.abs(x)) * _PER_OCTAVE) + _BUCKET_SHIFT
    size = F.when(F.abs(x) == float("inf"), F.lit(_BUCKET_TOP)).otherwise(step)
    # NaN compares as larger than any number and stays without a bucket.
    signed = F.when(x > 0, size).when(x < 0, -size).when(x == 0, F.lit(0))
    return F.when(~F.isnan(x), signed).cast("long")


def score_bucket(score: Column) -> Column:
    """Like ``magnitude_bucket``, on the odds of scores between 0 and 1.

    Classifier scores crowd near 0 and near 1; odds spread both ends.
    """
    s = score.cast("double")
    return (
        F.when(F.isnan(s), F.lit(None).cast("long"))
        .when(s >= 1, magnitude_bucket(s) + _BUCKET_TOP)
        .when(s > 0, magnitude_bucket(s / (1 - s)))
        .otherwise(magnitude_bucket(s))
    )


def comparison_key(df: DataFrame, column: str) -> Column:
    """Value to compare rows by: long text shrinks to its SHA-256 and a mark.

    The mark makes a digest one character longer than any text kept whole, so the two
    cannot meet. Null stays null, and -0.0 equals 0.0.
    """
    dtype = df.schema[column].dataType
    value = col(column)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.when(
            F.octet_length(value) > _INLINE_BYTES, F.concat(F.sha2(value, 256), F.lit("#"))
        ).otherwise(value.cast("string"))
    if isinstance(dtype, FLOATING_TYPES):
        return value + F.lit(0.0).cast(dtype)
    return value
