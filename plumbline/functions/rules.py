"""Row rules. A rule is a predicate that is true where a row fails; null never fails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VALIDITY = "validity"
CONSISTENCY = "consistency"

# The known transaction types and the tolerance of the log amount.
TRANSACTION_TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
LOG_TOLERANCE = 1e-10


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    failure: Column
    needs: tuple[str, ...]


def outside(column: str, values: Sequence[object]) -> Column:
    return ~F.col(column).isin(*values)


def transaction_rules(types: Sequence[str] = TRANSACTION_TYPES) -> list[Rule]:
    c = F.col
    step0 = c("step") - 1
    rules = [
        Rule("step_non_positive", VALIDITY, c("step") <= 0, ("step",)),
        Rule("amount_negative", VALIDITY, c("amount") < 0, ("amount",)),
        Rule("unknown_transaction_type", VALIDITY, outside("type", types), ("type",)),
        Rule("isFraud_not_binary", VALIDITY, outside("isFraud", (0, 1)), ("isFraud",)),
        Rule("hour_outside_0_23", VALIDITY, ~c("hour").between(0, 23), ("hour",)),
        Rule("day_negative", VALIDITY, c("day") < 0, ("day",)),
    ]
    for flag in ("is_transfer", "is_cash_out", "is_merchant_destination"):
        rules.append(Rule(f"{flag}_not_binary", VALIDITY, outside(flag, (0, 1)), (flag,)))
    rules += [
        Rule("hour_inconsistent_with_step", CONSISTENCY,
             c("hour") != F.pmod(step0, F.lit(24)), ("step", "hour")),
        Rule("day_inconsistent_with_step", CONSISTENCY,
             c("day") != F.floor(step0 / 24), ("step", "day")),
        Rule("log_amount_inconsistent_with_amount", CONSISTENCY,
             F.abs(c("log_amount") - F.log1p("amount")) > LOG_TOLERANCE,
             ("amount", "log_amount")),
    ]
    for flag, value in (("is_transfer", "TRANSFER"), ("is_cash_out", "CASH_OUT")):
        rules.append(Rule(f"{flag}_inconsistent_with_type", CONSISTENCY,
                          c(flag) != (c("type") == value).cast("byte"), ("type", flag)))
    return rules


def applicable(rules: Sequence[Rule], columns: Sequence[str]) -> list[Rule]:
    present = set(columns)
    return [r for r in rules if present.issuperset(r.needs)]


def make_rules(kind: str, predicates: Mapping[str, Column]) -> list[Rule]:
    """Rules from plain predicates, always applicable."""
    return [Rule(name, kind, failure, ()) for name, failure in predicates.items()]
