"""Controlled, reproducible defects: missing, extreme, invalid and repeated values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import col, draw, require_columns
from plumbline.operators.ordering import draw_cuts
from plumbline.operators.sampling import exact_sample


def affected_rows(rows: int, rate: float) -> int:
    """Rows to change: the rounded share (half to even), at least one."""
    return max(1, round(rows * rate))


def _check(
    df: DataFrame, rates: Mapping[str, float], protected: Iterable[str]
) -> None:
    """Refuse columns that don't exist or may not change, and rates that take no value or all."""
    if len(rates) == 0:
        raise ValueError("There must be at least one column to take values from")
    require_columns(df, rates, "Degradation input")
    kept = sorted(c for c in rates if c in set(protected))
    odd = sorted(c for c, rate in rates.items() if rate <= 0.0 or rate >= 1.0)
    for names, why in ((kept, "Protected from defects"), (odd, "Rates lie strictly between 0 and 1, unlike those of")):
        if names:
            raise ValueError(f"{why}: {', '.join(names)}")


def missing_marks(
    df: DataFrame,
    rates: Mapping[str, float],
    key: Sequence[str],
    seed: int = 42,
    protected: Iterable[str] = (),
) -> dict[str, Column]:
    """Per column, a condition that holds for exactly ``affected_rows`` rows.

    Columns are drawn independently. ``key`` must identify rows.
    """
    _check(df, rates, protected)
    require_columns(df, key, "Degradation input")
    rows = df.count()
    if not rows:
        raise ValueError("The table is empty: there is no value to take")
    draws = {c: draw(seed, F.lit(c), *key) for c in rates}
    cuts = draw_cuts(df, draws, {c: affected_rows(rows, r) for c, r in rates.items()})
    return {c: draws[c] <= F.lit(cuts[c]) for c in rates}


def degrade(
    df: DataFrame,
    rates: Mapping[str, float],
    key: Sequence[str],
    seed: int = 42,
    protected: Iterable[str] = (),
) -> DataFrame:
    """Copy of the table with nulls in place of the drawn cells. Adds no shuffle."""
    marks = missing_marks(df, rates, key, seed, protected)
    return df.withColumns({c: F.when(~mark, col(c)) for c, mark in marks.items()})


def replace_cells(
    df: DataFrame,
    rates: Mapping[str, float],
    key: Sequence[str],
    replacement: Callable[[Column], Column],
    seed: int = 42,
    protected: Iterable[str] = (),
) -> DataFrame:
    """Put ``replacement(value)`` in place of the drawn cells."""
    marks = missing_marks(df, rates, key, seed, protected)
    return df.withColumns(
        {c: F.when(mark, replacement(col(c))).otherwise(col(c)) for c, mark in marks.items()}
    )


def inject_extremes(
    df: DataFrame, rates: Mapping[str, float], key: Sequence[str], factor: float, seed: int = 42
) -> DataFrame:
    """Multiply the drawn cells by ``factor``."""
    return replace_cells(df, rates, key, lambda v: v * F.lit(factor), seed)


def inject_invalid_categories(
    df: DataFrame, rates: Mapping[str, float], key: Sequence[str], value: str, seed: int = 42
) -> DataFrame:
    return replace_cells(df, rates, key, lambda _: F.lit(value), seed)


def inject_wrong_types(
    df: DataFrame, rates: Mapping[str, float], key: Sequence[str], text: str, seed: int = 42
) -> DataFrame:
    """Turn the columns into text and put ``text`` in the drawn cells."""
    as_text = df.withColumns({c: col(c).cast("string") for c in rates})
    return replace_cells(as_text, rates, key, lambda _: F.lit(text), seed)


def inject_duplicates(
    df: DataFrame, rate: float, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """Append a second copy of exactly ``affected_rows`` rows."""
    if not 0.0 < rate < 1.0:
        raise ValueError("The duplicate rate must be between 0 and 1")
    rows = df.count()
    if not rows:
        raise ValueError("The table is empty: there is no value to take")
    return df.unionByName(exact_sample(df, key, affected_rows(rows, rate), seed))


def degradation_audit(
    df: DataFrame,
    rates: Mapping[str, float],
    key: Sequence[str],
    seed: int = 42,
    protected: Iterable[str] = (),
) -> DataFrame:
    """``(column, rows, affected_rows)`` counted over the marked cells."""
    marks = missing_marks(df, rates, key, seed, protected)
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(mark).alias(f"m{i}") for i, mark in enumerate(marks.values())],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.col("rows"), F.col(f"m{i}").alias("affected_rows")
        )
        for i, c in enumerate(marks)
    ]
    return counts.select(F.inline(F.array(*entries)))


def corruption_log(
    df: DataFrame,
    rates: Mapping[str, float],
    key: Sequence[str],
    seed: int = 42,
    protected: Iterable[str] = (),
) -> DataFrame:
    """``(*key, column, true_value)`` of every cell that ``degrade`` nulls."""
    marks = missing_marks(df, rates, key, seed, protected)
    cells = [
        F.when(
            mark, F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("true_value"))
        )
        for c, mark in marks.items()
    ]
    return df.select(*key, F.inline(F.array_compact(F.array(*cells))))


def repair_accuracy(log: DataFrame, repaired: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(column, cells, repaired_cells, exact_cells)`` after some repair of a degraded table."""
    columns = [c for c in repaired.columns if c not in key]
    cells = repaired.select(
        *key,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        ),
    )
    return (
        log.join(cells, [*key, "column"], "left")
        .groupBy("column")
        .agg(
            F.count("*").alias("cells"),
            F.count_if(F.col("value").isNotNull()).alias("repaired_cells"),
            F.count_if(F.col("value") == F.col("true_value")).alias("exact_cells"),
        )
    )
