"""Repeated stratified folds as a table ``(*key, target, repeat, fold)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import col, draw, require_columns
from plumbline.operators.ordering import rank_by_draw
from plumbline.operators.sampling import two_class_counts


def stratified_folds(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    folds: int = 5,
    repeats: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Assign every row to one fold per repeat; class counts of folds differ by one at most.

    Only key and target are shuffled, once, split into many pieces per class.
    """
    if folds < 2 or repeats < 1:
        raise ValueError("Folds must be at least 2 and repeats at least 1")
    require_columns(df, [target, *key], "Fold input")
    counts = two_class_counts(df, target)
    if min(counts.values()) < folds:
        raise ValueError("Every class needs at least one row per fold")
    rows = (
        df.where(col(target).isNotNull())
        .select(*key, target)
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        .withColumn("_draw", draw(seed, "repeat", *key))
    )
    ranked = rank_by_draw(rows, ["repeat", target], "_draw", key, "_rank")
    return ranked.select(
        *key, target, "repeat", ((F.col("_rank") - 1) % folds + 1).cast("int").alias("fold")
    )


def training_rows(assigned: DataFrame, repeat: int, fold: int) -> DataFrame:
    return assigned.where((F.col("repeat") == repeat) & (F.col("fold") != fold))


def validation_rows(assigned: DataFrame, repeat: int, fold: int) -> DataFrame:
    return assigned.where((F.col("repeat") == repeat) & (F.col("fold") == fold))


def other_folds(folds: int):
    """Map rows counted per fold to each training set that contains the fold."""

    def regroup(counts: DataFrame) -> DataFrame:
        return counts.withColumn(
            "fold",
            F.explode(
                F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda f: f != F.col("fold"))
            ),
        )

    return regroup


def fold_membership(assigned: DataFrame, folds: int) -> DataFrame:
    """``(repeat, fold, train_rows, validation_rows)`` with positives, from one aggregate.

    Expects the target under the name ``target``.
    """
    sizes = assigned.groupBy("repeat", "fold").agg(
        F.count("*").alias("validation_rows"),
        F.count_if(F.col("target") == 1).alias("validation_positives"),
    )
    train = (
        other_folds(folds)(sizes)
        .groupBy("repeat", "fold")
        .agg(
            F.sum("validation_rows").alias("train_rows"),
            F.sum("validation_positives").alias("train_positives"),
        )
    )
    return train.join(sizes, ["repeat", "fold"])


def target_fingerprint(df: DataFrame, target: str, key: Sequence[str]) -> DataFrame:
    """``(rows, fingerprint)``: one number bound to every key and target, in any order."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in key], col(target).cast("string"))
    sixty_bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.bit_xor(sixty_bits).alias("fingerprint"))


def check_same_target(
    df: DataFrame, target: str, key: Sequence[str], expected: tuple[int, int]
) -> None:
    """Refuse folds that were made for other rows or other target values."""
    found = target_fingerprint(df, target, key).first()
    if found["rows"] != expected[0]:
        raise ValueError("The number of rows does not match the shared folds")
    if found["fingerprint"] != expected[1]:
        raise ValueError("Keys or target values do not match the shared folds")
