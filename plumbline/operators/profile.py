"""Column profiles, duplicates, distributions and rule failures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.expressions import (
    FLOATING_TYPES,
    NUMERIC_TYPES,
    col,
    comparison_key,
    magnitude_bucket,
    numeric_columns,
    require_columns,
    string_columns,
)
from plumbline.functions.rules import CONSISTENCY, VALIDITY, Rule
from plumbline.operators.ordering import exact_quantiles, quantile_targets

STATISTICS = ("min", "max", "mean", "median", "std", "skewness")
IMBALANCE_RATE = 0.01
# Spark stops generating code for aggregates of more than 100 fields; a column takes 12.
COLUMNS_AT_ONCE = 8


# Characters of a text that values of one count are first ordered by.
HEAD = 64


def _long(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    """One row per cell: ``(column, value)``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])
    return df.select(F.inline(cells))


def _rows(frame: DataFrame, entries: Sequence[Column]) -> DataFrame:
    return frame.select(F.inline(F.array(*entries)))


def _null_count(c: str) -> Column:
    return F.count_if(col(c).isNull())


def _with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "null_rate": F.when(F.col("rows") > 0, F.col("null_count") / F.col("rows")),
            "non_null_count": F.col("rows") - F.col("null_count"),
        }
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, rows, null_count, null_rate, non_null_count)`` from one aggregate."""
    names = list(columns or df.columns)
    one = df.agg(
        F.count("*").alias("rows"), *[_null_count(c).alias(f"n{i}") for i, c in enumerate(names)]
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("null_count"))
        for i, c in enumerate(names)
    ]
    return _with_rates(_rows(one, entries))


def missing_columns(df: DataFrame) -> DataFrame:
    """Only the columns that have nulls, with their number."""
    return null_counts(df).where(F.col("null_count") > 0).select("column", "null_count")


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """``(column, n_unique)``; null counts as one value.

    Every column is scanned by itself and shuffles its own distinct values, so rows are never
    expanded and a columnar source is read once in all. Checkpoint a table first if it is costly
    to derive.
    """
    names = list(columns or df.columns)
    if approximate:
        one = df.agg(
            *[
                (F.approx_count_distinct(col(c)) + F.max(col(c).isNull().cast("int"))).alias(
                    f"u{i}"
                )
                for i, c in enumerate(names)
            ]
        )
        return _rows(
            one,
            [
                F.struct(
                    F.lit(c).alias("column"),
                    F.coalesce(F.col(f"u{i}"), F.lit(0)).cast("long").alias("n_unique"),
                )
                for i, c in enumerate(names)
            ],
        )
    counts = [
        df.select(comparison_key(df, c).alias("value"))
        .distinct()
        .agg(F.lit(c).alias("column"), F.count("*").alias("n_unique"))
        for c in names
    ]
    return reduce(DataFrame.unionAll, counts)


# Per-column expressions are SQL text: one call to the JVM per column keeps wide tables quick.
_MOMENTS = {
    "min": "min", "max": "max", "mean": "avg", "std": "stddev_samp", "skewness": "skewness",
}


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _statistics(df: DataFrame, c: str) -> dict[str, str]:
    """The aggregates of one column, null where it holds no numbers; NaN is left out."""
    dtype = df.schema[c].dataType
    if not isinstance(dtype, NUMERIC_TYPES):
        return {s: "CAST(NULL AS DOUBLE)" for s in _MOMENTS}
    x = f"CAST({_name(c)} AS DOUBLE)"
    if isinstance(dtype, FLOATING_TYPES):
        x = f"IF(isnan({x}), NULL, {x})"
    # NaN is larger than infinity, so one comparison keeps out both.
    return {
        s: f"CASE WHEN abs({f}({x})) < double('Infinity') THEN {f}({x}) END"
        for s, f in _MOMENTS.items()
    }


def _struct(fields: Mapping[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{_text(n)}, {v}" for n, v in fields.items()) + ")"


def numeric_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, min, max, mean, std, skewness)`` from one aggregate."""
    names = list(columns or numeric_columns(df))
    entries = [
        F.expr(_struct({"column": _text(c), **_statistics(df, c)})).alias(f"s{i}")
        for i, c in enumerate(names)
    ]
    return _rows(df.agg(*entries), [F.col(f"s{i}") for i in range(len(names))])


def exact_extremes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, min, max)`` of whole-number and decimal columns as text, no digit lost.

    ``numeric_statistics`` gives doubles, which hold integers up to 2**53 exactly.
    """
    exact = (T.IntegralType, T.DecimalType)
    named = [f.name for f in df.schema if isinstance(f.dataType, exact)]
    names = list(named if columns is None else columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, min string, max string")
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(col(c)).cast("string").alias("min"),
            F.max(col(c)).cast("string").alias("max"),
        ).alias(f"e{i}")
        for i, c in enumerate(names)
    ]
    return _rows(df.agg(*entries), [F.col(f"e{i}") for i in range(len(names))])


def medians(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    names = list(columns or numeric_columns(df))
    if approximate:
        one = df.agg(
            *[
                F.percentile_approx(col(c).cast("double"), 0.5, 100_000).alias(f"m{i}")
                for i, c in enumerate(names)
            ]
        )
        return _rows(
            one,
            [
                F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("median"))
                for i, c in enumerate(names)
            ],
        )
    return exact_quantiles(df, names, [0.5]).select(
        "column", F.col("quantile").alias("median")
    )


def _distinct_and_medians(df: DataFrame) -> tuple[dict[str, int], dict[str, float]]:
    """Non-null distinct values and exact medians of all columns.

    The distinct values of a column, counted once, give its cardinality and also the histogram
    that shows where its median lies.
    """
    parts = []
    for f in df.schema.fields:
        number = "CAST(v AS DOUBLE)" if isinstance(f.dataType, NUMERIC_TYPES) else "CAST(NULL AS DOUBLE)"
        parts.append(
            df.select(comparison_key(df, f.name).alias("v"))
            .where("v IS NOT NULL")
            .groupBy("v")
            .agg(F.expr("count(*) AS n"))
            .selectExpr(f"{_text(f.name)} AS column", f"{number} AS x", "n")
        )
    histogram = (
        reduce(DataFrame.unionAll, parts)
        .groupBy("column", magnitude_bucket(F.col("x")).alias("_bucket"))
        .agg(
            F.expr("count(*) AS _distinct"),
            F.expr("sum(n) AS _count"),
            F.expr("min(x) AS _low"),
            F.expr("max(x) AS _high"),
        )
        .withColumn("n_unique", F.sum("_distinct").over(W.partitionBy("column")))
    )
    # Text and NaN have no bucket: they count as values and take no part in the median.
    rows = quantile_targets(histogram, ["column"], [0.5], ["n_unique"]).collect()
    distinct = {r["column"]: r["n_unique"] for r in rows}
    ends: dict[str, list[Row]] = {}
    for r in rows:
        if r["_bucket"] is not None:
            ends.setdefault(r["column"], []).append(r)
    middle: dict[str, float] = {}
    found: list[Row] = []
    for c, pair in ends.items():
        if all(r["_low"] == r["_high"] for r in pair):
            at = {r["_end"]: r["_low"] for r in pair}
            share = pair[0]["_share"] if at["low"] != at["high"] else 0.0
            middle[c] = at["low"] + share * (at["high"] - at["low"]) if share else at["low"]
        else:
            found += [
                Row(**{n: v for n, v in r.asDict().items() if n != "n_unique"}) for r in pair
            ]
    if found:
        open_columns = [c for c in numeric_columns(df) if any(r["column"] == c for r in found)]
        for r in exact_quantiles(df, open_columns, [0.5], found=found).collect():
            middle[r["column"]] = r["quantile"]
    return distinct, middle


def _profile_entries(df: DataFrame, approximate: bool) -> list[Column]:
    """Aggregates that profile each column, as structs ``s0``, ``s1`` and so on."""
    distinct: dict[str, int] = {}
    middle: dict[str, float] = {}
    if not approximate:
        distinct, middle = _distinct_and_medians(df)
    entries = []
    for i, f in enumerate(df.schema.fields):
        q = _name(f.name)
        nulls = f"count_if({q} IS NULL)"
        unique, median = f"{distinct.get(f.name, 0)}L", "NULL"
        if approximate:
            unique = f"approx_count_distinct({q})"
            if isinstance(f.dataType, NUMERIC_TYPES):
                median = f"percentile_approx(CAST({q} AS DOUBLE), 0.5, 100000)"
        elif middle.get(f.name) is not None:
            median = f"double({_text(repr(middle[f.name]))})"
        numbers = {**_statistics(df, f.name), "median": f"CAST({median} AS DOUBLE)"}
        fields = {
            "position": str(i),
            "column": _text(f.name),
            "dtype": _text(f.dataType.simpleString()),
            "rows": "count(*)",
            "null_count": nulls,
            "null_rate": f"CASE WHEN count(*) > 0 THEN {nulls} / count(*) END",
            "non_null_count": f"count(*) - {nulls}",
            "n_unique": f"{unique} + IF({nulls} > 0, 1L, 0L)",
            **{s: numbers[s] for s in STATISTICS},
        }
        entries.append(F.expr(_struct(fields)).alias(f"s{i}"))
    return entries


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, nulls, distinct values and, for numbers, six statistics.

    Counts and moments come from one aggregate per ``COLUMNS_AT_ONCE`` columns, each reading just
    those; the approximate mode needs no other pass.
    """
    entries = _profile_entries(df, approximate)
    parts = []
    for start in range(0, len(entries), COLUMNS_AT_ONCE):
        chunk = entries[start : start + COLUMNS_AT_ONCE]
        names = [f"s{i}" for i in range(start, start + len(chunk))]
        parts.append(_rows(df.agg(*chunk), [F.col(n) for n in names]))
    return reduce(DataFrame.unionAll, parts)


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(rows, distinct_rows, duplicate_rows, duplicate_rate)`` over whole rows.

    Copies combine before the shuffle, and long text travels as a digest.
    """
    names = list(columns or df.columns)
    keys = [comparison_key(df, c).alias(f"k{i}") for i, c in enumerate(names)]
    copies = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(names))]).agg(
        F.count("*").alias("copies")
    )
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")
    ).select(
        "rows",
        "distinct_rows",
        (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"),
        F.when(
            F.col("rows") > 0, (F.col("rows") - F.col("distinct_rows")) / F.col("rows")
        ).alias("duplicate_rate"),
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """``(value, count, rate)`` of every value, null included."""
    counts = df.groupBy(col(column).alias("value")).agg(F.count("*").alias("count"))
    total = df.agg(F.count("*").alias("total")).scalar()
    return counts.withColumn("rate", F.col("count") / total)


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values of each string column, ties broken by value.

    ``(column, rank, value, count, rate)``. Long text is counted by digest. The place k is found by
    count and the start of the text, by a limit per partition; only values up to it, and those that tie with it
    in both, are looked up whole and ordered by value.
    """
    names = list(columns or string_columns(df))
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            comparison_key(df, c).cast("string").alias("key"),
            F.substring(col(c).cast("string"), 1, HEAD).alias("head"),
        )
        for c in names
    ]
    counts = (
        df.select(F.inline(F.array(*entries)))
        .groupBy("column", "key")
        .agg(F.count("*").alias("count"), F.min("head").alias("head"))
    )
    often = W.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("head"))
    last = (
        counts.withColumn("r", F.row_number().over(often))
        .where(F.col("r") <= k)
        .groupBy("column")
        .agg(F.max_by(F.struct("count", "head"), "r").alias("last"))
    )
    up_to = F.col("last.head").isNull() | F.coalesce(F.col("head") <= F.col("last.head"), F.lit(False))
    ranked = (
        counts.join(F.broadcast(last), "column")
        .where((F.col("count") > F.col("last.count")) | ((F.col("count") == F.col("last.count")) & up_to))
        .select("column", "key", "count")
    )
    cells = _long(df, names, col).where(F.octet_length("value") > 64)
    texts = (
        cells.withColumn("key", F.concat(F.sha2("value", 256), F.lit("#")))
        .join(ranked.where(F.col("key").endswith("#")).select("column", "key"), ["column", "key"])
        .groupBy("column", "key")
        .agg(F.max("value").alias("text"))
    )
    total = df.agg(F.count("*").alias("total")).scalar()
    named = ranked.join(texts, ["column", "key"], "left").withColumn(
        "value", F.coalesce("text", "key")
    )
    best = W.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "column",
        "rank",
        "value",
        "count",
        (F.col("count") / total).alias("rate"),
    )


def outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """``(column, low, high, outliers, rate)`` beyond k interquartile ranges from the quartiles."""
    names = list(columns or numeric_columns(df))
    quartiles: dict[str, dict[float, float]] = {c: {} for c in names}
    for r in exact_quantiles(df, names, [0.25, 0.75]).collect():
        quartiles[r["column"]][r["probability"]] = r["quantile"]
    fences = {
        c: (q[0.25] - k * (q[0.75] - q[0.25]), q[0.75] + k * (q[0.75] - q[0.25]))
        for c, q in quartiles.items()
        if q
    }

    def outside(c: str) -> Column:
        if c not in fences:
            return F.lit(False)
        x, (low, high) = col(c).cast("double"), fences[c]
        return (x < F.lit(low)) | ((x > F.lit(high)) & ~F.isnan(x))

    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(fences.get(c, (None, None))[0]).cast("double").alias("low"),
                F.lit(fences.get(c, (None, None))[1]).cast("double").alias("high"),
                F.count_if(outside(c)).alias("outliers"),
                (F.count_if(outside(c)) / F.count(col(c))).alias("rate"),
            ).alias(f"s{i}")
            for i, c in enumerate(names)
        ]
    )
    return _rows(one, [F.col(f"s{i}") for i in range(len(names))])


def constant_columns(
    df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.99
) -> DataFrame:
    """``(column, top_share, is_constant, is_near_constant)`` by the most frequent value."""
    parts = [
        df.select(comparison_key(df, c).alias("value"))
        .groupBy("value")
        .agg(F.count("*").alias("n"))
        .agg(F.lit(c).alias("column"), (F.max("n") / F.sum("n")).alias("top_share"))
        for c in (columns or df.columns)
    ]
    return reduce(DataFrame.unionAll, parts).withColumns(
        {
            "is_constant": F.col("top_share") == 1,
            "is_near_constant": F.col("top_share") >= share,
        }
    )


def class_imbalance(df: DataFrame, target: str, below: float = IMBALANCE_RATE) -> DataFrame:
    """``(minority_class_rate, detected)``: a modelling risk, not a defect of the data."""
    return (
        value_distribution(df, target)
        .agg(F.min("rate").alias("minority_class_rate"))
        .withColumn(
            "detected", F.coalesce(F.col("minority_class_rate") < below, F.lit(False))
        )
    )


def time_range(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def _rule_counts(rules: Sequence[Rule]) -> list[Column]:
    return [F.count_if(r.failure).alias(f"r{i}") for i, r in enumerate(rules)]


def _rule_entries(rules: Sequence[Rule]) -> list[Column]:
    return [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.kind).alias("kind"),
            F.col(f"r{i}").alias("failures"),
        )
        for i, r in enumerate(rules)
    ]


def check_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(rule, kind, failures)``: all rules counted in one pass over the table."""
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, kind string, failures long")
    return _rows(df.agg(*_rule_counts(rules)), _rule_entries(rules))


def rule_totals(failures: DataFrame) -> DataFrame:
    return failures.groupBy("kind").agg(
        F.count("*").alias("rules"), F.sum("failures").alias("failures")
    )


def _total(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0]) if parts else F.lit(0).cast("long")


def table_profile(
    df: DataFrame, rules: Sequence[Rule] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """One row with everything the quality score needs: the whole table read twice.

    One pass counts rows, nulls and rule failures, the other distinct rows. ``extra`` aggregates
    join the first pass.
    """
    counts = df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        _total([_null_count(c) for c in df.columns]).alias("missing_cells"),
        *_rule_counts(rules),
        *extra,
    )
    of_kind: dict[str, Column] = {}
    for kind in (VALIDITY, CONSISTENCY):
        chosen = [F.col(f"r{i}") for i, r in enumerate(rules) if r.kind == kind]
        of_kind[f"{kind}_checks"] = F.lit(len(chosen))
        of_kind[f"{kind}_failures"] = _total(chosen)
    duplicates = duplicate_rows(df).select("duplicate_rows").scalar()
    out = counts.withColumns({**of_kind, "duplicate_rows": duplicates})
    return out if extra else out.drop(*[f"r{i}" for i in range(len(rules))])


def profile_report(
    df: DataFrame, target: str, time: str, rules: Sequence[Rule] = (), approximate: bool = False
) -> DataFrame:
    """The whole profile as one nested row, ready for a JSON sink."""
    require_columns(df, [target, time], "Profile input")

    def listed(table: DataFrame, *order: str) -> Column:
        cells = F.struct(*order, *[c for c in table.columns if c not in order])
        return table.agg(F.sort_array(F.collect_list(cells)).alias("v")).scalar()

    # A report is one row with all classes; `value_distribution` gives them as rows.
    classes = value_distribution(df, target).withColumn("value", F.col("value").cast("string"))
    span = F.struct(F.min(time).alias("min"), F.max(time).alias("max")).alias("span")
    out = table_profile(df, rules, [span]).withColumns(
        {
            "classes": listed(classes, "value"),
            "profiles": listed(column_profile(df, approximate), "position"),
            "extremes": listed(exact_extremes(df), "column"),
        }
    )
    minority = F.array_min(F.transform("classes", lambda c: c["rate"]))
    strings = string_columns(df)
    report = {
        "report_version": F.lit("1.0"),
        "dimensions": F.struct("rows", "columns"),
        "duplicates": F.struct(
            "duplicate_rows",
            F.when(F.col("rows") > 0, F.col("duplicate_rows") / F.col("rows")).alias(
                "duplicate_rate"
            ),
        ),
        "columns": F.col("profiles"),
        "exact_extremes": F.col("extremes"),
        "class_distribution": F.struct(
            F.lit(target).alias("column"), F.col("classes").alias("values")
        ),
        "time_range": F.struct(F.lit(time).alias("column"), "span.min", "span.max"),
        "class_imbalance": F.struct(
            F.coalesce(minority < IMBALANCE_RATE, F.lit(False)).alias("detected"),
            minority.alias("minority_class_rate"),
        ),
        "validity": F.struct("validity_checks", "validity_failures"),
        "consistency": F.struct("consistency_checks", "consistency_failures"),
        "rule_failures": F.array(*_rule_entries(rules)).cast(
            "array<struct<rule:string,kind:string,failures:bigint>>"
        ),
    }
    if strings:
        report["top_values"] = listed(top_values(df, strings), "column", "rank")
    return out.select(*[c.alias(n) for n, c in report.items()])
