"""One-hot encoding of any number of categories.

Categories are rows of a table, looked up per cell, and an encoded row holds one position per column
instead of one column per category. No name and no list of categories comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.durability import durable
from plumbline.functions.expressions import col
from plumbline.operators.ordering import BROADCAST_ROWS, rank_by_draw

# A category with at least this share of its column's cells is looked up without a shuffle. At most
# 1 / share categories of a column can have it.
HEAVY_SHARE = 0.001
# MLlib names every position of a vector in the schema, on the driver and in each plan. Vectors with more
# positions carry their length only.
NAMED = 10_000


def category_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, index, rows)`` of every category; a missing one has the index 0.

    Indices are dense per column. They follow the MD5 of the value, so that they are found piecewise
    and no task sorts a whole column.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    )
    counts = (
        df.select(F.inline(cells))
        .groupBy("column", "value")
        .agg(F.count("*").alias("rows"))
        .withColumn("_draw", F.md5("value"))
    )
    ranked = rank_by_draw(counts, ["column"], "_draw", ["value"], "_rank")
    return ranked.select("column", "value", (F.col("_rank") - 1).alias("index"), "rows")


def category_sizes(categories: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Categories per column, in the order of the columns."""
    found = {r["column"]: r["n"] for r in categories.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return {c: found.get(c, 0) for c in columns}


def _looked_up(df: DataFrame, column: str, own: DataFrame, size: int) -> DataFrame:
    value = col(column).cast("string")
    if size <= BROADCAST_ROWS:
        known = F.broadcast(own.select(F.col("value").alias("_value"), F.col("index").alias("_index")))
        joined = df.join(known, value.eqNullSafe(F.col("_value")), "left")
        index = F.col("_index")
    else:
        cells = own.agg(F.sum("rows")).scalar()
        heavy = F.col("rows") >= F.lit(HEAVY_SHARE) * cells
        first = own.where(heavy).select(F.col("value").alias("_often"), F.col("index").alias("_known"))
        rest = own.where(~heavy).select(F.col("value").alias("_value"), F.col("index").alias("_index"))
        hashed = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.AtomicType, T.NumericType))]
        # Rows found already spread over all tasks; what they meet there is not used.
        spread = F.concat(F.lit("#"), F.pmod(F.xxhash64(*[col(c) for c in hashed]), F.lit(4096)).cast("string"))
        joined = (
            df.join(F.broadcast(first), value.eqNullSafe(F.col("_often")), "left")
            .withColumn("_cell", F.when(F.col("_known").isNull(), value).otherwise(spread))
            .join(rest, F.col("_cell").eqNullSafe(F.col("_value")), "left")
        )
        index = F.coalesce("_known", "_index")
    return joined.select(*[index.alias(c) if c == column else col(c) for c in df.columns])


def with_indices(
    df: DataFrame, categories: DataFrame, sizes: Mapping[str, int]
) -> DataFrame:
    """Each column of ``sizes`` as the index of its category, null where it was not learned.

    A small table of categories is broadcast after a look at its size. Of a large one only the
    heavy categories are; the others are joined by value.
    """
    for c, size in sizes.items():
        df = _looked_up(df, c, categories.where(F.col("column") == c), size)
    return df


@F.arrow_udf(VectorUDT())
def _marked(cells: pa.Array) -> pa.Array:
    """Structs of a vector's fields, as vectors."""
    return cells


def _sparse(size: int, indices: Column, values: Column, name: str) -> Column:
    """A sparse vector whose positions have no names."""
    cell = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).cast("int").alias("size"),
        indices.cast("array<int>").alias("indices"),
        values.cast("array<double>").alias("values"),
    )
    return _marked(cell).alias(name, metadata={"ml_attr": {"num_attrs": size}})


def vector_encoder(spark: SparkSession, sizes: Mapping[str, int]) -> Callable[[DataFrame], DataFrame]:
    """What turns index columns into sparse vectors with a 1 at the index; a null index gives zeros only.

    A column without categories becomes a vector of one zero. The positions of a column of more than
    ``NAMED`` categories have no names.
    """
    named = {c: n for c, n in sizes.items() if n <= NAMED}
    wide = {c: n for c, n in sizes.items() if n > NAMED}
    encoded = _named_encoder(spark, named)

    def encode(df: DataFrame) -> DataFrame:
        vectors = {}
        for c, n in wide.items():
            nothing = col(c).isNull()
            at = F.when(nothing, F.array().cast("array<int>")).otherwise(F.array(col(c).cast("int")))
            ones = F.when(nothing, F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0)))
            vectors[c] = _sparse(n, at, ones, c)
        rows = encoded(df)
        return rows.select(*[vectors.get(c, col(c)) for c in df.columns]) if vectors else rows

    return encode


def _named_encoder(spark: SparkSession, sizes: Mapping[str, int]) -> Callable[[DataFrame], DataFrame]:
    if not sizes:
        return lambda df: df
    raw = {c: f"_index{i}" for i, c in enumerate(sizes)}
    vectors = {c: f"_vector{i}" for i, c in enumerate(sizes)}
    # The encoder learns sizes from the largest index; one above it stands for a category not learned.
    widest = spark.createDataFrame(
        [tuple(float(max(n, 1) - 1) for n in sizes.values())],
        T.StructType([T.StructField(name, T.DoubleType()) for name in raw.values()]),
    )
    model = OneHotEncoder(
        inputCols=list(raw.values()), outputCols=list(vectors.values()), handleInvalid="keep", dropLast=True
    ).fit(widest)

    def encode(df: DataFrame) -> DataFrame:
        rows = df.withColumns(
            {raw[c]: F.coalesce(col(c).cast("double"), F.lit(float(max(n, 1)))) for c, n in sizes.items()}
        )
        return model.transform(rows).select(
            *[F.col(vectors[c]).alias(c) if c in sizes else col(c) for c in df.columns]
        )

    return encode


def as_vectors(df: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    return vector_encoder(df.sparkSession, sizes)(df)


def _width(df: DataFrame, column: str) -> int | None:
    """Positions a column takes in an assembled vector, None if its schema doesn't tell."""
    field = df.schema[column]
    if not isinstance(field.dataType, VectorUDT):
        return 1
    return field.metadata.get("ml_attr", {}).get("num_attrs")


def assembled(df: DataFrame, columns: Sequence[str], output: str) -> DataFrame:
    """Add the columns side by side as one vector; null and NaN are errors.

    Up to ``NAMED`` positions MLlib does it. Longer vectors are sparse and have no names of positions.
    """
    widths = [_width(df, c) for c in columns]
    if None in widths or sum(widths) <= NAMED:
        return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)
    parts, start = [], 0
    for c, n in zip(columns, widths, strict=True):
        parts.append(_entries(df, c, start))
        start += n
    entries = F.filter(F.concat(*parts), lambda e: e["value"] != 0)
    at, values = F.col("_entries")["at"], F.col("_entries")["value"]
    rows = df.withColumn("_entries", entries)
    return rows.select(*[col(c) for c in df.columns], _sparse(start, at, values, output))


def _entries(df: DataFrame, column: str, start: int) -> Column:
    """Position and value of a cell's entries, positions counted from ``start``."""
    message = F.lit(f"Missing value in column {column}, which is to be part of a vector")
    kind = "array<struct<at:int,value:double>>"
    if isinstance(df.schema[column].dataType, VectorUDT):
        cell = F.unwrap_udt(col(column))

        def entry(i: Column, v: Column) -> Column:
            return F.struct((i + start).alias("at"), v.alias("value"))

        # Positions of a dense vector come from its cell: a list of all would be a constant of the plan, on the driver.
        dense = F.transform(cell["values"], lambda v, i: entry(i, v))
        sparse = F.zip_with(cell["indices"], cell["values"], entry)
        found = F.when(cell["indices"].isNull(), dense).otherwise(sparse)
        bad = col(column).isNull()
    else:
        number = col(column).cast("double")
        found = F.array(F.struct(F.lit(start).alias("at"), number.alias("value")))
        bad = number.isNull() | F.isnan(number)
    return F.when(bad, F.raise_error(message).cast(kind)).otherwise(found.cast(kind))


def learn_one_hot(train: DataFrame, columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Encoder that replaces each column by a sparse vector over the categories learned."""
    categories = durable(category_table(train, columns))
    sizes = category_sizes(categories, columns)
    encode = vector_encoder(train.sparkSession, sizes)
    return lambda df: encode(with_indices(df, categories, sizes))


def one_hot_sparse(
    df: DataFrame, columns: Sequence[str], train: DataFrame | None = None
) -> DataFrame:
    """The columns as sparse one-hot vectors; a category not learned gives zeros only."""
    return learn_one_hot(df if train is None else train, columns)(df)
