"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import ascii_lower, space_words

# Frequent function words of the languages that documents come in.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was are by at this or from an not "
    "der die und das von zu mit sich auf für ist im dem nicht ein eine als auch den des "
    "de la le et les des en un une du que est pour qui dans par sur pas plus au ce avec "
    "el los las y del se por con no para su al lo como más o una es"
).split()
SYMBOLS = "#*$%&|<>"

# Fixed by contract.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A measure may not be under `low` or over `high`."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def sql(self) -> str:
        bounds = [f"{self.measure} >= {self.low}"] * (self.low is not None)
        bounds += [f"{self.measure} <= {self.high}"] * (self.high is not None)
        return "(" + " AND ".join(bounds) + ")"


# Measures are SQL over the columns of `measures`; ratios are to the number of words or lines.
RULES = (
    Rule("length", "n_words", low=LEAST_WORDS),
    Rule("word_length", "word_chars / n_words", low=2.5, high=14),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("shouting", "n_shouts / n_words", high=0.1),
    Rule("stop_words", "n_stop_words / n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines / n_lines", high=0.4),
    Rule("bullet_lines", "n_bullet_lines / n_lines", high=0.9),
    Rule("open_lines", "n_open_lines / n_lines", high=0.3),
    Rule("repeated_words", "n_repeat_words / n_words", high=0.4),
)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows that come twice or more.

    Windows are sorted by a 64-bit hash next to their place; equal neighbours repeat. A document of
    20,000 words meets a wrong equality with a probability of about 1e-11.
    """
    windows = F.transform(
        F.slice(words, 1, F.size(words) - 2),
        lambda w, i: F.struct(
            F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
        ),
    )

    def places(s: Column) -> Column:
        again = F.filter(
            s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        )
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    covered = F.aggregate(
        _let(F.sort_array(windows), places),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")
        ),
        lambda a: a["n"],
    )
    return F.when(F.size(words) >= 3, covered).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """Counts that the rules compare, one row per document, without user functions."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words, lines = F.col("_words"), F.col("_lines")
    cut = docs.select(
        F.col("doc_id"),
        text.alias("_text"),
        space_words(text).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("_lines"),
    )
    long = lambda c, name: c.cast("long").alias(name)
    kinds = F.transform(lines, lambda x: F.trim(x))
    counts = (
        long(F.size(words), "n_words"),
        long(F.length(F.array_join(words, "")), "word_chars"),
        long(F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")), "n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines)), "n_dup_lines"),
        long(_repeated_words(words), "n_repeat_words"),
        long(F.size(lines), "n_lines"),
        long(F.size(F.filter(words, lambda w: ascii_lower(w).isin(*STOP_WORDS))), "n_stop_words"),
        long(F.size(F.filter(words, lambda w: w.endswith("!!") | w.endswith("??"))), "n_shouts"),
        long(
            F.size(F.filter(kinds, lambda x: F.substring(x, 1, 1).isin("-", "*", "•"))),
            "n_bullet_lines",
        ),
        long(
            F.size(F.filter(kinds, lambda x: x.endswith("...") | x.endswith("…"))), "n_open_lines"
        ),
    )
    # Through a generator: a later filter on counts would otherwise be pushed down and put the whole
    # chain of expressions into one, computed anew for each word.
    return cut.select("doc_id", F.inline_outer(F.array(F.struct(*counts))))


BASE_FAILED = (
    f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words)"
)


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The table as one condition; a document without words fails."""
    checks = " AND ".join(r.sql() for r in rules)
    return f"CASE WHEN n_words = 0 OR {BASE_FAILED} THEN false ELSE {checks} END"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents (doc_id, text) with their counts, base_failed and kept.

    Words are runs of characters other than blank and \\t-\\r; lines are split at \\n and counted if
    they hold a word. Null, empty and blank texts have no words, fail the base and are not kept.
    Repeated rows and null ids are judged like others, row by row; other columns are left out. An
    empty table gives no rows. Nothing is shuffled.
    """
    return measures(docs).withColumns(
        {"base_failed": F.expr(BASE_FAILED), "kept": F.expr(verdict_sql(rules))}
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns; verdicts are made on the rows themselves."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(row.alias("doc_id"), F.col("text"))
    return judge(held, rules).where("kept").select("doc_id.*")
