"""Column transformations learned on training rows and applied anywhere.

Learning runs one or two aggregates and keeps a handful of numbers; applying is plain column
arithmetic. The statistics of many columns come from one job.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expressions import col, finite_or_null
from plumbline.operators.folds import other_folds
from plumbline.operators.ordering import exact_quantiles

MISSING_CATEGORY = "__NULL__"


def _number(c: str) -> Column:
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def learn_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, dict[float, float]]:
    found: dict[str, dict[float, float]] = {c: {} for c in columns}
    for r in exact_quantiles(df, columns, probabilities).collect():
        found[r["column"]][r["probability"]] = r["quantile"]
    return found


def learn_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column, from one aggregate."""
    one = df.agg(
        *[F.avg(_number(c)).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(_number(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (one[f"a{i}"], one[f"s{i}"]) for i, c in enumerate(columns)}


def learn_fill(df: DataFrame, columns: Sequence[str], strategy: str) -> dict[str, float]:
    if strategy == "median":
        values = {c: q.get(0.5) for c, q in learn_quantiles(df, columns, [0.5]).items()}
    elif strategy == "mean":
        values = {c: m for c, (m, _) in learn_moments(df, columns).items()}
    else:
        raise ValueError("Numeric imputation takes the strategy 'median' or 'mean'")
    return values


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` of the non-null values as text."""
    entries = [
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("count"))
    )


def learn_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value of each column, the smallest one on ties."""
    best = W.partitionBy("column").orderBy(F.desc("count"), "value")
    rows = (
        value_counts(df, columns)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= 1)
        .collect()
    )
    modes = {r["column"]: r["value"] for r in rows}
    for c in columns:
        if c not in modes:
            raise ValueError(f"Column '{c}' has no value to impute from")
    return modes


def learn_categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str | None]]:
    """Sorted categories of each column; missing, where it occurs, is None and comes first.

    They are to be names of columns, which the driver holds in any case. For columns of very
    many categories there is ``categories.one_hot_sparse``.
    """
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            col(c).cast("string").alias("value"),
        )
        for c in columns
    ]
    found: dict[str, list[str | None]] = {c: [] for c in columns}
    values = df.select(F.inline(F.array(*entries))).distinct()
    for r in values.collect():
        found[r["column"]].append(r["value"])
    for own in found.values():
        own.sort(key=lambda v: (v is not None, v or ""))
    return found


def fill_numbers(df: DataFrame, fills: Mapping[str, float | None]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(_number(c), F.lit(v).cast("double")) for c, v in fills.items()}
    )


def fill_values(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fills.items()}
    )


def rescale(df: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {
            c: (_number(c) - F.lit(m).cast("double")) / F.lit(s).cast("double")
            for c, (m, s) in scales.items()
        }
    )


def encode(df: DataFrame, categories: Mapping[str, Sequence[str | None]]) -> DataFrame:
    """Replace each column by one 0/1 indicator per category.

    Two indicators of one name, or one named like a column that stays, are an error.
    """
    names = [indicator_name(c, v) for c, values in categories.items() for v in values]
    taken = sorted(n for n, times in Counter(names).items() if times > 1)
    taken += sorted(set(names) & (set(df.columns) - set(categories)))
    if taken:
        raise ValueError(f"Indicators would share a name: {', '.join(taken)}")

    def flag(c: str, v: str | None) -> Column:
        value = col(c).cast("string")
        return value.isNull() if v is None else F.coalesce(value == v, F.lit(False))

    flags = {
        indicator_name(c, v): flag(c, v).cast("int")
        for c, values in categories.items()
        for v in values
    }
    return df.withColumns(flags).drop(*categories)


def impute_numeric(
    df: DataFrame, columns: Sequence[str], strategy: str, train: DataFrame | None = None
) -> DataFrame:
    """Fill nulls and NaN; the columns become double. A column without values stays null."""
    return fill_numbers(df, learn_fill(df if train is None else train, columns, strategy))


def learn_values(
    df: DataFrame, columns: Sequence[str], strategy: str, fill_value: object = None
) -> dict[str, object]:
    if strategy == "constant":
        if fill_value is None:
            raise ValueError("Constant imputation needs a fill value")
        return dict.fromkeys(columns, fill_value)
    if strategy == "most_frequent":
        return dict(learn_modes(df, columns))
    raise ValueError("Categorical imputation takes 'most_frequent' or 'constant'")


def impute_categorical(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str,
    fill_value: object = None,
    train: DataFrame | None = None,
) -> DataFrame:
    source = df if train is None else train
    return fill_values(df, learn_values(source, columns, strategy, fill_value))


def learn_scale(
    df: DataFrame, columns: Sequence[str], method: str
) -> dict[str, tuple[float, float]]:
    """Centre and spread per column; a spread of 0 becomes 1."""
    if method == "standard":
        pairs = learn_moments(df, columns)
    elif method == "robust":
        pairs = {
            c: (q.get(0.5), q[0.75] - q[0.25] if q else None)
            for c, q in learn_quantiles(df, columns, [0.25, 0.5, 0.75]).items()
        }
    else:
        raise ValueError("Scaling takes the method 'standard' or 'robust'")
    return {c: (m, unit_if_zero(s)) for c, (m, s) in pairs.items()}


def unit_if_zero(spread: float | None) -> float | None:
    return 1.0 if spread == 0 else spread


def scale_numeric(
    df: DataFrame, columns: Sequence[str], method: str, train: DataFrame | None = None
) -> DataFrame:
    return rescale(df, learn_scale(df if train is None else train, columns, method))


def log_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log1p in place; a null, negative or non-finite value fails the query."""

    def checked(c: str) -> Column:
        x = col(c).cast("double")
        ok = finite_or_null(x).isNotNull() & (x >= 0)
        return F.when(ok, F.log1p(x)).otherwise(
            F.raise_error(F.lit(f"log_transform needs finite, non-negative values in '{c}'"))
        )

    return df.withColumns({c: checked(c) for c in columns})


def indicator_name(column: str, category: str | None) -> str:
    return f"{column}={MISSING_CATEGORY if category is None else category}"


def one_hot_encode(
    df: DataFrame, columns: Sequence[str], train: DataFrame | None = None
) -> DataFrame:
    """Indicators of the categories learned; a category not learned gives zeros only."""
    return encode(df, learn_categories(df if train is None else train, columns))


def fold_moments(
    df: DataFrame, columns: Sequence[str], folds: int, keep: Sequence[str] = ("repeat", "fold")
) -> DataFrame:
    """``(column, *keep, train_rows, mean, std)`` of the training rows of all folds at once.

    ``fold`` is the one held out. Rows are counted under their own fold and merged afterwards, so
    the table is not copied once per training set.
    """
    by = ["column", *keep]
    sums = df.groupBy(*keep).agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(_number(c)).alias("n"),
                F.avg(_number(c)).alias("m"),
                F.var_pop(_number(c)).alias("v"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    parts = sums.select(
        *keep, F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))]))
    ).where(F.col("n") > 0)
    merged = W.partitionBy(*by)
    return (
        other_folds(folds)(parts)
        .withColumn("total", F.sum("n").over(merged))
        .withColumn("mean", F.sum(F.col("n") * F.col("m")).over(merged) / F.col("total"))
        .groupBy(*by)
        .agg(
            F.first("total").alias("train_rows"),
            F.first("mean").alias("mean"),
            F.sqrt(
                F.sum(F.col("n") * (F.col("v") + F.pow(F.col("m") - F.col("mean"), 2)))
                / F.first("total")
            ).alias("std"),
        )
    )


def fold_quantiles(
    df: DataFrame, columns: Sequence[str], folds: int, keep: Sequence[str] = ("repeat", "fold")
) -> DataFrame:
    """``(column, *keep, q25, median, q75)`` of the training rows of all folds at once."""
    stable = [c for c in keep if c != "fold"]
    return (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75], keep, other_folds(folds), stable)
        .groupBy("column", *keep)
        .agg(
            *[
                F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n)
                for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))
            ]
        )
    )


def fold_statistics(
    df: DataFrame, columns: Sequence[str], folds: int, keep: Sequence[str] = ("repeat", "fold")
) -> DataFrame:
    """Training statistics of every column for all folds: those of both functions above."""
    return fold_moments(df, columns, folds, keep).join(
        fold_quantiles(df, columns, folds, keep), ["column", *keep]
    )


def fold_modes(
    df: DataFrame, columns: Sequence[str], folds: int, keep: Sequence[str] = ("repeat", "fold")
) -> DataFrame:
    """``(column, *keep, value)``: the most frequent training value of every column for all folds.

    The smallest value wins ties. Rows are counted under their own fold.
    """
    entries = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    counts = (
        df.select(*keep, F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value", *keep)
        .agg(F.count("*").alias("n"))
    )
    merged = other_folds(folds)(counts).groupBy("column", "value", *keep).agg(F.sum("n").alias("n"))
    # Of equal counts the smallest value: the least of (-count, value).
    return merged.groupBy("column", *keep).agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("value"))
