"""Leakage-safe features of a transaction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expressions import flag_equals, flag_prefix, require_columns

# The columns that would leak the label or identify an account.
LEAKING_COLUMNS = (
    "nameOrig",
    "oldbalanceOrg",
    "newbalanceOrig",
    "nameDest",
    "oldbalanceDest",
    "newbalanceDest",
    "isFlaggedFraud",
)


def hour_of_day(step: str) -> Column:
    """Hour 0 to 23 of a 1-based hourly step, also for steps below 1."""
    return F.pmod(F.col(step) - 1, F.lit(24)).cast("short")


def day_number(step: str) -> Column:
    return F.floor((F.col(step) - 1) / 24).cast("short")


def add_features(
    df: DataFrame,
    step: str = "step",
    kind: str = "type",
    amount: str = "amount",
    destination: str = "nameDest",
) -> DataFrame:
    require_columns(df, (step, kind, amount, destination), "Feature input")
    return df.withColumns(
        {
            "hour": hour_of_day(step),
            "day": day_number(step),
            "log_amount": F.log1p(amount),
            "is_transfer": flag_equals(kind, "TRANSFER"),
            "is_cash_out": flag_equals(kind, "CASH_OUT"),
            "is_merchant_destination": flag_prefix(destination, "M"),
        }
    )


def prepare_features(
    df: DataFrame, drop: Sequence[str] = LEAKING_COLUMNS, **names: str
) -> DataFrame:
    """Add the features, then drop leaking columns where they exist."""
    return add_features(df, **names).drop(*drop)
