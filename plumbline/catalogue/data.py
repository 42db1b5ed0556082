"""Queries on sources, features, splits, profiles and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalogue.common import (
    DEGRADED,
    FEATURES,
    RATES,
    TX,
    degraded,
    query,
    rounded,
    scratch,
    table,
    transactions,
    with_sql,
)
from plumbline.functions.expressions import at_least, to_number
from plumbline.functions.rules import CONSISTENCY, VALIDITY, applicable, make_rules, transaction_rules
from plumbline.operators import degrade as dg
from plumbline.operators import profile as pf
from plumbline.operators.features import add_features, prepare_features
from plumbline.operators.ordering import exact_quantiles, running_totals
from plumbline.operators.quality import quality_of, score_report
from plumbline.operators.split import (
    split_label,
    split_summary,
    split_temporally,
    temporal_cutoff,
)
from plumbline.operators.transforms import impute_categorical, impute_numeric
from plumbline.sources import tables as src

def order_rules():
    validity = {
        "price_below_2000": F.expr("o_totalprice < 2000"),
        "status_unknown": F.expr("o_orderstatus NOT IN ('O', 'F', 'P')"),
        "priority_unknown": F.expr("o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"),
    }
    consistency = {
        "open_before_1995": F.expr(
            "o_orderstatus = 'O' AND o_orderdate < timestamp_ntz'1995-01-01 00:00:00'"
        ),
    }
    return make_rules(VALIDITY, validity) + make_rules(CONSISTENCY, consistency)


QUALITY_ORDERS = """
SELECT rows, "columns", missing_cells, validity_failures, consistency_failures, duplicate_rows,
       round(completeness, 9) AS completeness, round(validity, 9) AS validity,
       round(consistency, 9) AS consistency, round(uniqueness, 9) AS uniqueness,
       round(0.3 * completeness + 0.25 * validity + 0.25 * consistency + 0.2 * uniqueness, 9)
         AS data_quality_score
FROM (
  SELECT *, 1 - missing_cells / (rows * 6.0) AS completeness,
         1 - validity_failures / (rows * 3.0) AS validity,
         1 - consistency_failures / (rows * 1.0) AS consistency,
         1 - duplicate_rows / (rows * 1.0) AS uniqueness
  FROM (
    SELECT count(*) AS rows, CAST(6 AS BIGINT) AS "columns",
           CAST(sum((o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT
                  + (o_orderstatus IS NULL)::INT + (o_totalprice IS NULL)::INT
                  + (o_orderdate IS NULL)::INT + (o_orderpriority IS NULL)::INT) AS BIGINT)
             AS missing_cells,
           count(*) FILTER (o_totalprice < 2000)
             + count(*) FILTER (o_orderstatus NOT IN ('O', 'F', 'P'))
             + count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))
             AS validity_failures,
           count(*) FILTER (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1995-01-01')
             AS consistency_failures,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows
    FROM orders))
"""


@query("quality_score_orders", QUALITY_ORDERS)
def quality_score_orders(spark, folder):
    return rounded(
        quality_of(table(spark, folder, "orders"), order_rules()).select(
            "rows", "columns", "missing_cells", "validity_failures", "consistency_failures",
            "duplicate_rows", "completeness", "validity", "consistency", "uniqueness",
            "data_quality_score",
        ),
        9,
    )


CUSTOMERS = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("scan_csv", CUSTOMERS)
def scan_csv(spark, folder):
    customers = table(spark, folder, "customer")
    path = scratch(spark, "customer") + ".csv"
    src.write_csv(customers, path)
    return rounded(src.scan_table(spark, path, customers.schema), 9, skip=("c_acctbal",))


@query("scan_parquet", CUSTOMERS)
def scan_parquet(spark, folder):
    return rounded(
        src.scan_table(spark, f"{folder}/customer.parquet"), 9, skip=("c_acctbal",)
    )


@query("convert_csv_to_parquet", CUSTOMERS)
def convert_csv_to_parquet(spark, folder):
    customers = table(spark, folder, "customer")
    base = scratch(spark, "convert")
    src.write_csv(customers, base + ".csv")
    out = src.convert_csv(
        spark, base + ".csv", base + ".parquet", customers.schema, customers.columns, "c_custkey"
    )
    return rounded(out, 9, skip=("c_acctbal",))


@query(
    "load_validated_table",
    "SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
)
def load_validated_table(spark, folder):
    parts = src.load_table(
        spark, f"{folder}/part.parquet", ["p_partkey", "p_brand", "p_size", "p_retailprice"]
    )
    out = parts.select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return rounded(out, 9, skip=("p_retailprice",))


FEATURE_COLUMNS = """event_id, step, type, amount, "isFraud", hour, day,
  round(log_amount, 9) AS log_amount, is_transfer, is_cash_out, is_merchant_destination"""


@query("event_features", with_sql(TX, FEATURES) + f"SELECT {FEATURE_COLUMNS} FROM features")
def event_features(spark, folder):
    return rounded(prepare_features(transactions(spark, folder)), 9, skip=("amount",))


@query(
    "floor_features_below_origin",
    with_sql(TX) + """
    SELECT event_id, step - 300 AS step, ((step - 301) % 24 + 24) % 24 AS hour,
           CAST(floor((step - 301) / 24.0) AS BIGINT) AS day
    FROM tx""",
)
def floor_features_below_origin(spark, folder):
    shifted = transactions(spark, folder).withColumn("step", F.col("step") - 300)
    return rounded(add_features(shifted).select("event_id", "step", "hour", "day"))


CUTOFF = """
steps AS (SELECT DISTINCT step FROM tx WHERE step IS NOT NULL),
cut AS (SELECT min(step) AS cutoff FROM (
  SELECT step FROM steps ORDER BY step DESC
  LIMIT (SELECT least(greatest(ceil(count(*) * 0.2::DOUBLE), 1), count(*) - 1)::BIGINT FROM steps)))
"""


@query(
    "temporal_split_rows",
    with_sql(TX, CUTOFF) + """
    SELECT event_id, step, CASE WHEN step < cutoff THEN 'development' ELSE 'temporal_test' END
      AS split FROM tx, cut""",
)
def temporal_split_rows(spark, folder):
    development, held = split_temporally(transactions(spark, folder).select("event_id", "step"))
    return development.withColumn("split", F.lit("development")).unionByName(
        held.withColumn("split", F.lit("temporal_test"))
    )


@query(
    "temporal_split_summary",
    with_sql(TX, CUTOFF) + """
    SELECT CASE WHEN step < cutoff THEN 'development' ELSE 'temporal_test' END AS split,
           count(*) AS rows, min(step) AS min_time, max(step) AS max_time,
           count(*) FILTER ("isFraud" = 1) AS positive_rows
    FROM tx, cut GROUP BY 1""",
)
def temporal_split_summary(spark, folder):
    tx = transactions(spark, folder)
    return split_summary(tx, "step", "isFraud", temporal_cutoff(tx))


@query(
    "temporal_split_text",
    """
    WITH steps AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS step FROM events),
    cut AS (SELECT min(step) AS cutoff FROM (SELECT step FROM steps ORDER BY step DESC
      LIMIT (SELECT least(greatest(ceil(count(*) * 0.2::DOUBLE), 1), count(*) - 1)::BIGINT FROM steps)))
    SELECT event_id, CASE WHEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') < cutoff THEN 'development'
                          ELSE 'temporal_test' END AS split, cutoff
    FROM events, cut""",
)
def temporal_split_text(spark, folder):
    """Times as text, to the microsecond."""
    rows = table(spark, folder, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time")
    )
    cutoff = temporal_cutoff(rows, "time")
    return rows.select("event_id", split_label("time", cutoff).alias("split"), F.lit(cutoff).alias("cutoff"))


def _micros(spark, folder):
    rows = table(spark, folder, "events")
    since = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return rows.select("event_id", "event_type", since.alias("micros"))


@query(
    "quantiles_event_micros",
    """WITH q AS (SELECT event_type, quantile_cont(epoch_us(ts)::DOUBLE, [0.0, 0.5, 1.0]) AS v
                  FROM events GROUP BY event_type)
       SELECT event_type, unnest([0.0::DOUBLE, 0.5, 1.0]) AS probability,
              unnest(v) AS quantile FROM q""",
)
def quantiles_event_micros(spark, folder):
    """Times that crowd in a narrow range far from zero."""
    found = exact_quantiles(_micros(spark, folder), ["micros"], [0.0, 0.5, 1.0], ["event_type"])
    return found.select("event_type", "probability", "quantile")


@query(
    "running_totals_event_micros",
    """WITH steps AS (SELECT event_type, epoch_us(ts) AS micros, count(*) AS n FROM events GROUP BY ALL)
       SELECT event_type, micros, n, CAST(coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY micros
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before FROM steps""",
)
def running_totals_event_micros(spark, folder):
    """Events of each kind before every time."""
    steps = _micros(spark, folder).groupBy("event_type", "micros").agg(F.count("*").alias("n"))
    return running_totals(steps, ["event_type"], "micros", ["n"])


@query(
    "temporal_split_orders",
    """
    WITH days AS (SELECT o_orderkey, o_orderstatus,
                         date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS day FROM orders),
    steps AS (SELECT DISTINCT day FROM days),
    cut AS (SELECT min(day) AS cutoff FROM (SELECT day FROM steps ORDER BY day DESC
      LIMIT (SELECT least(greatest(ceil(count(*) * 0.25::DOUBLE), 1), count(*) - 1)::BIGINT FROM steps)))
    SELECT CASE WHEN day < cutoff THEN 'development' ELSE 'temporal_test' END AS split,
           count(*) AS rows, min(day) AS min_time, max(day) AS max_time,
           count(*) FILTER (o_orderstatus = 'F') AS positive_rows
    FROM days, cut GROUP BY 1""",
)
def temporal_split_orders(spark, folder):
    days = table(spark, folder, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.expr("timestampdiff(DAY, timestamp_ntz'1992-01-01 00:00:00', o_orderdate)").alias("day"),
    )
    return split_summary(days, "day", "y", temporal_cutoff(days, "day", 0.25))


@query(
    "write_splits_read_holdout",
    with_sql(TX, FEATURES, CUTOFF)
    + f"SELECT {FEATURE_COLUMNS} FROM features, cut WHERE step >= cutoff",
)
def write_splits_read_holdout(spark, folder):
    tx = transactions(spark, folder)
    # The writer wants the whole schema; features are derived from the columns that are there.
    rest = {f.name: F.lit(None).cast(f.dataType) for f in src.TRANSACTION_SCHEMA if f.name not in tx.columns}
    path = scratch(spark, "splits")
    src.write_temporal_splits(tx.withColumns(rest), path)
    return rounded(src.read_split(spark, path, "temporal_test"), 9, skip=("amount",))


@query(
    "positive_rows",
    with_sql(TX) + """SELECT event_id, amount FROM tx WHERE "isFraud" = 1""",
)
def positive_rows(spark, folder):
    return transactions(spark, folder).where(F.col("isFraud") == 1).select("event_id", "amount")


@query(
    "score_threshold",
    """SELECT doc_id, CAST((n_chars % 101) / 100.0::DOUBLE >= 0.5 AS BIGINT) AS y_pred
       FROM documents""",
)
def score_threshold(spark, folder):
    score = (F.col("n_chars") % 101) / 100.0
    return table(spark, folder, "documents").select(
        "doc_id", at_least(score, 0.5).cast("long").alias("y_pred")
    )


@query(
    "numbers_from_text",
    """SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS number,
              coalesce(try_cast(event_type AS DOUBLE), -1.0) AS filled FROM events""",
)
def numbers_from_text(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        to_number(F.regexp_extract("props", "([0-9]+)", 1)).alias("number"),
        F.coalesce(to_number("event_type"), F.lit(-1.0)).alias("filled"),
    )


def _sql_profile(
    source: str, numbers: list[str], others: list[str], digits: int = 6
) -> str:
    """Profile in plain SQL; skewness is spelled out by its population moments."""
    parts = []
    for c in [*numbers, *others]:
        base = (
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) / count(*)::DOUBLE, {digits}) AS null_rate, "
            f"count({c}) AS non_null_count, "
            f"count(DISTINCT {c}) + max(({c} IS NULL)::INT)::BIGINT AS n_unique, "
        )
        if c in numbers:
            x = f"{c}::DOUBLE"
            mean = f"(SELECT avg({x}) FROM {source})"
            base += (
                f"round(min({x}), {digits}) AS \"min\", round(max({x}), {digits}) AS \"max\", "
                f"round(avg({x}), {digits}) AS mean, round(median({x}), {digits}) AS median, "
                f"round(stddev_samp({x}), {digits}) AS std, "
                f"round(avg(power({x} - {mean}, 3)) / power(avg(power({x} - {mean}, 2)), 1.5), {digits}) "
                f"+ 0.0 AS skewness "
            )
        else:
            base += ", ".join(
                f"CAST(NULL AS DOUBLE) AS \"{s}\""
                for s in ("min", "max", "mean", "median", "std", "skewness")
            )
        parts.append(f"{base} FROM {source}")
    return " UNION ALL ".join(parts)


@query(
    "column_profile_lineitem",
    _sql_profile(
        "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
         "l_extendedprice", "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus", "l_shipdate"],
        7,
    ),
)
def column_profile_lineitem(spark, folder):
    profile = pf.column_profile(table(spark, folder, "lineitem"))
    return rounded(profile.drop("position", "dtype"), 7)


@query(
    "column_profile_degraded",
    with_sql(TX, DEGRADED)
    + _sql_profile("degraded", ["event_id", "step", "amount", '"isFraud"'], ["type"]).replace(
        "'\"isFraud\"'", "'isFraud'"
    ),
)
def column_profile_degraded(spark, folder):
    return rounded(pf.column_profile(degraded(spark, folder)).drop("position", "dtype"))


_ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "numeric_profile_orders",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(min({c})::DOUBLE, 6) AS "min",
            round(max({c})::DOUBLE, 6) AS "max", round(avg({c}), 4) AS mean,
            round(stddev_samp({c}), 4) AS std FROM orders"""
        for c in _ORDER_NUMBERS
    ),
)
def numeric_profile_orders(spark, folder):
    stats = pf.numeric_statistics(table(spark, folder, "orders"), _ORDER_NUMBERS)
    return stats.select(
        "column", F.round(F.col("min").cast("double"), 6).alias("min"),
        F.round(F.col("max").cast("double"), 6).alias("max"),
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
    )


@query(
    "missing_by_column",
    with_sql(TX, DEGRADED) + """
    SELECT 'type' AS "column", count(*) AS null_count FROM degraded WHERE type IS NULL
    UNION ALL SELECT 'amount', count(*) FROM degraded WHERE amount IS NULL""",
)
def missing_by_column(spark, folder):
    return pf.missing_columns(degraded(spark, folder))


DUPLICATES = """
SELECT rows, distinct_rows, rows - distinct_rows AS duplicate_rows,
       round((rows - distinct_rows) / rows::DOUBLE, 6) AS duplicate_rate
FROM (SELECT (SELECT count(*) FROM {t}) AS rows,
             (SELECT count(*) FROM (SELECT DISTINCT {c} FROM {t})) AS distinct_rows)
"""


@query("duplicate_rows_documents", DUPLICATES.format(t="documents", c="text"))
def duplicate_rows_documents(spark, folder):
    return rounded(pf.duplicate_rows(table(spark, folder, "documents"), ["text"]))


@query(
    "duplicate_rows_lineitem",
    DUPLICATES.format(t="lineitem", c="l_orderkey, l_linenumber"),
)
def duplicate_rows_lineitem(spark, folder):
    items = table(spark, folder, "lineitem")
    return rounded(pf.duplicate_rows(items, ["l_orderkey", "l_linenumber"]))


@query("duplicate_rows_lineitem_whole", DUPLICATES.format(t="lineitem", c="*"))
def duplicate_rows_lineitem_whole(spark, folder):
    return rounded(pf.duplicate_rows(table(spark, folder, "lineitem")))


@query("duplicate_rows_documents_whole", DUPLICATES.format(t="documents", c="*"))
def duplicate_rows_documents_whole(spark, folder):
    return rounded(pf.duplicate_rows(table(spark, folder, "documents")))


@query(
    "value_distribution_lineitem",
    """SELECT l_returnflag AS value, count(*) AS "count",
         round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS rate
       FROM lineitem GROUP BY 1""",
)
def value_distribution_lineitem(spark, folder):
    return rounded(pf.value_distribution(table(spark, folder, "lineitem"), "l_returnflag"))


@query(
    "class_distribution_labels",
    """SELECT CAST(toxic AS BIGINT) AS value, count(*) AS "count",
         round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS rate
       FROM labels GROUP BY 1""",
)
def class_distribution_labels(spark, folder):
    return rounded(pf.value_distribution(table(spark, folder, "labels"), "toxic"))


@query(
    "top_categories_documents",
    """WITH cells AS (
         SELECT 'text' AS "column", text AS value FROM documents
         UNION ALL SELECT 'lang', lang FROM documents
         UNION ALL SELECT 'source', source FROM documents),
       counts AS (
         SELECT "column", value, count(*) AS n FROM cells GROUP BY 1, 2),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r
                  FROM counts)
       SELECT "column", r AS "rank", md5(value) AS value_md5, n AS "count",
              round(n / (SELECT count(*) FROM documents)::DOUBLE, 6) AS rate
       FROM ranked WHERE r <= 20""",
)
def top_categories_documents(spark, folder):
    best = pf.top_values(table(spark, folder, "documents"), ["text", "lang", "source"])
    return rounded(
        best.select("column", "rank", F.md5("value").alias("value_md5"), "count", "rate")
    )


@query(
    "class_imbalance_events",
    with_sql(TX) + """
    SELECT round(min(n) / sum(n)::DOUBLE, 6) AS minority_class_rate,
           min(n) / sum(n)::DOUBLE < 0.01 AS detected
    FROM (SELECT count(*) AS n FROM tx GROUP BY "isFraud")""",
)
def class_imbalance_events(spark, folder):
    return rounded(pf.class_imbalance(transactions(spark, folder), "isFraud"))


@query(
    "time_range_events",
    with_sql(TX) + "SELECT min(step) AS min_time, max(step) AS max_time FROM tx",
)
def time_range_events(spark, folder):
    return pf.time_range(transactions(spark, folder), "step")


def _defective(spark, folder):
    """Features with defects: errors lose an hour, large and small amounts break other rules."""
    f = add_features(transactions(spark, folder))
    kind = F.col("type")
    return f.withColumns(
        {
            "hour": F.when(kind == "DEBIT", F.col("hour") + 1).otherwise(F.col("hour")),
            "day": F.when(F.col("amount") > 200, -F.col("day")).otherwise(F.col("day")),
            "log_amount": F.when(F.col("amount") < 1, F.lit(0.0)).otherwise(F.col("log_amount")),
            "is_transfer": F.when(kind == "CASH_IN", 1).otherwise(F.col("is_transfer")),
            "is_cash_out": F.when(F.col("amount") > 250, 2).otherwise(F.col("is_cash_out")),
            "isFraud": F.when(F.col("amount") > 300, 3).otherwise(F.col("isFraud")),
            "type": F.when(F.col("amount") < 2, "UNKNOWN").otherwise(kind),
            "amount": F.when(F.col("amount") < 0.5, -F.col("amount")).otherwise(F.col("amount")),
            "step": F.when(F.col("step") < 3, F.col("step") - 3).otherwise(F.col("step")),
        }
    )


DEFECTIVE = """
defective AS (
  SELECT CASE WHEN type = 'DEBIT' THEN hour + 1 ELSE hour END AS hour,
         CASE WHEN amount > 200 THEN -day ELSE day END AS day,
         CASE WHEN amount < 1 THEN 0.0 ELSE log_amount END AS log_amount,
         CASE WHEN type = 'CASH_IN' THEN 1 ELSE is_transfer END AS is_transfer,
         CASE WHEN amount > 250 THEN 2 ELSE is_cash_out END AS is_cash_out,
         CASE WHEN amount > 300 THEN 3 ELSE "isFraud" END AS is_fraud,
         CASE WHEN amount < 2 THEN 'UNKNOWN' ELSE type END AS type,
         CASE WHEN amount < 0.5 THEN -amount ELSE amount END AS amount,
         CASE WHEN step < 3 THEN step - 3 ELSE step END AS step,
         is_merchant_destination
  FROM features
),
failures AS (
  SELECT * FROM (VALUES
    ('step_non_positive', 'validity', (SELECT count(*) FROM defective WHERE step <= 0)),
    ('amount_negative', 'validity', (SELECT count(*) FROM defective WHERE amount < 0)),
    ('unknown_transaction_type', 'validity', (SELECT count(*) FROM defective
      WHERE type NOT IN ('CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER'))),
    ('isFraud_not_binary', 'validity', (SELECT count(*) FROM defective WHERE is_fraud NOT IN (0, 1))),
    ('hour_outside_0_23', 'validity', (SELECT count(*) FROM defective WHERE hour NOT BETWEEN 0 AND 23)),
    ('day_negative', 'validity', (SELECT count(*) FROM defective WHERE day < 0)),
    ('is_transfer_not_binary', 'validity', (SELECT count(*) FROM defective WHERE is_transfer NOT IN (0, 1))),
    ('is_cash_out_not_binary', 'validity', (SELECT count(*) FROM defective WHERE is_cash_out NOT IN (0, 1))),
    ('is_merchant_destination_not_binary', 'validity', (SELECT count(*) FROM defective
      WHERE is_merchant_destination NOT IN (0, 1))),
    ('hour_inconsistent_with_step', 'consistency', (SELECT count(*) FROM defective
      WHERE hour <> ((step - 1) % 24 + 24) % 24)),
    ('day_inconsistent_with_step', 'consistency', (SELECT count(*) FROM defective
      WHERE day <> floor((step - 1) / 24.0))),
    ('log_amount_inconsistent_with_amount', 'consistency', (SELECT count(*) FROM defective
      WHERE abs(log_amount - ln(1 + amount)) > 1e-10)),
    ('is_transfer_inconsistent_with_type', 'consistency', (SELECT count(*) FROM defective
      WHERE is_transfer <> (type = 'TRANSFER')::INT)),
    ('is_cash_out_inconsistent_with_type', 'consistency', (SELECT count(*) FROM defective
      WHERE is_cash_out <> (type = 'CASH_OUT')::INT))
  ) AS f(rule, kind, failures)
)"""


@query(
    "rule_failures_events",
    with_sql(TX, FEATURES, DEFECTIVE) + "SELECT rule, kind, failures FROM failures",
)
def rule_failures_events(spark, folder):
    df = _defective(spark, folder)
    return pf.check_rules(df, applicable(transaction_rules(), df.columns))


@query(
    "rule_totals_events",
    with_sql(TX, FEATURES, DEFECTIVE) + """
    SELECT kind, count(*) AS rules, CAST(sum(failures) AS BIGINT) AS failures
    FROM failures GROUP BY kind""",
)
def rule_totals_events(spark, folder):
    df = _defective(spark, folder)
    return pf.rule_totals(pf.check_rules(df, applicable(transaction_rules(), df.columns)))


@query(
    "quality_score_defective_events",
    with_sql(TX, FEATURES, DEFECTIVE) + """
    , t AS (SELECT count(*) AS n FROM defective),
    v AS (SELECT 1 - sum(failures) / (9.0 * max(n)) AS s FROM failures, t WHERE kind = 'validity'),
    k AS (SELECT 1 - sum(failures) / (5.0 * max(n)) AS s FROM failures, t WHERE kind = 'consistency')
    SELECT round(v.s, 9) AS validity, round(k.s, 9) AS consistency,
           round(0.3 + 0.25 * v.s + 0.25 * k.s + 0.2, 9) AS data_quality_score FROM v, k""",
)
def quality_score_defective_events(spark, folder):
    df = _defective(spark, folder)
    out = quality_of(df, applicable(transaction_rules(), df.columns))
    return rounded(out.select("validity", "consistency", "data_quality_score"), 9)


@query(
    "score_saved_report",
    with_sql(TX, FEATURES, DEFECTIVE) + """
    , t AS (SELECT count(*) AS n FROM defective),
    v AS (SELECT 1 - sum(failures) / (9.0 * max(n)) AS s FROM failures, t WHERE kind = 'validity'),
    k AS (SELECT 1 - sum(failures) / (5.0 * max(n)) AS s FROM failures, t WHERE kind = 'consistency')
    SELECT round(v.s, 9) AS validity, round(k.s, 9) AS consistency,
           round(0.3 + 0.25 * v.s + 0.25 * k.s + 0.2, 9) AS data_quality_score FROM v, k""",
)
def score_saved_report(spark, folder):
    """A report is written as JSON, read back and scored from its fields alone."""
    df = _defective(spark, folder)
    report = pf.profile_report(df, "isFraud", "step", applicable(transaction_rules(), df.columns))
    path = scratch(spark, "report")
    src.write_json(report, path)
    out = score_report(src.read_json(spark, path, report.schema))
    return rounded(out.select("validity", "consistency", "data_quality_score"), 9)


@query(
    "quality_score_degraded",
    with_sql(TX, DEGRADED) + """
    SELECT round(c, 9) AS completeness, round(u, 9) AS uniqueness,
           round(0.3 * c + 0.5 + 0.2 * u, 9) AS data_quality_score
    FROM (SELECT 1 - (count(*) FILTER (type IS NULL) + count(*) FILTER (amount IS NULL))
                     / (count(*) * 4.0) AS c,
                 (SELECT count(*) FROM (SELECT DISTINCT step, type, amount, "isFraud" FROM degraded))
                   / (count(*) * 1.0) AS u
          FROM degraded)""",
)
def quality_score_degraded(spark, folder):
    out = quality_of(degraded(spark, folder).drop("event_id"))
    return rounded(out.select("completeness", "uniqueness", "data_quality_score"), 9)


@query(
    "profile_big_integers",
    """SELECT 'big' AS "column", CAST(min(b) AS VARCHAR) AS "min", CAST(max(b) AS VARCHAR) AS "max"
       FROM (SELECT 9007199254740993 + o_orderkey AS b FROM orders)
       UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR)
       FROM orders""",
)
def profile_big_integers(spark, folder):
    """Extremes of numbers beyond what a double holds exactly."""
    orders = table(spark, folder, "orders")
    return pf.exact_extremes(
        orders.select((F.lit(9007199254740993) + F.col("o_orderkey")).alias("big"), "o_custkey")
    )


@query(
    "profile_report_events",
    with_sql(TX, FEATURES, DEFECTIVE) + """
    , t AS (SELECT count(*) AS n FROM defective),
    c AS (SELECT is_fraud, count(*) AS n FROM defective GROUP BY 1)
    SELECT (SELECT n FROM t) AS rows, CAST(13 AS BIGINT) AS "columns", CAST(0 AS BIGINT) AS duplicate_rows,
           (SELECT min(step) FROM defective) AS min_time, (SELECT max(step) FROM defective) AS max_time,
           (SELECT count(*) FROM c) AS classes,
           (SELECT min(n) / (SELECT n FROM t)::DOUBLE < 0.01 FROM c) AS imbalanced,
           (SELECT CAST(sum(failures) AS BIGINT) FROM failures WHERE kind = 'validity')
             AS validity_failures,
           (SELECT CAST(sum(failures) AS BIGINT) FROM failures WHERE kind = 'consistency')
             AS consistency_failures,
           (SELECT round(median(amount), 6) FROM defective) AS median_amount,
           (SELECT count(DISTINCT type) FROM defective) AS types""",
)
def profile_report_events(spark, folder):
    """The report goes through its JSON sink and back before its fields are picked."""
    df = _defective(spark, folder)
    report = pf.profile_report(df, "isFraud", "step", applicable(transaction_rules(), df.columns))
    path = scratch(spark, "report")
    src.write_json(report, path)
    median = F.filter("columns", lambda c: c["column"] == "amount")[0]["median"]
    types = F.filter("top_values", lambda v: v["column"] == "type")
    return rounded(
        src.read_json(spark, path, report.schema).select(
            "dimensions.rows",
            "dimensions.columns",
            "duplicates.duplicate_rows",
            F.col("time_range.min").alias("min_time"),
            F.col("time_range.max").alias("max_time"),
            F.size("class_distribution.values").alias("classes"),
            F.col("class_imbalance.detected").alias("imbalanced"),
            "validity.validity_failures",
            "consistency.consistency_failures",
            median.alias("median_amount"),
            F.size(types).alias("types"),
        )
    )


@query(
    "mcar_degrade",
    with_sql(TX, DEGRADED) + """SELECT event_id, step, type, amount, "isFraud" FROM degraded""",
)
def mcar_degrade(spark, folder):
    return degraded(spark, folder)


@query(
    "mcar_audit",
    with_sql(TX) + """
    SELECT c AS "column", count(*) AS rows,
           CAST(greatest(1, round_even(count(*) * max(rate), 0)) AS BIGINT) AS affected_rows
    FROM tx, (VALUES ('amount', 0.05::DOUBLE), ('type', 0.10::DOUBLE)) AS r(c, rate)
    GROUP BY c""",
)
def mcar_audit(spark, folder):
    return dg.degradation_audit(transactions(spark, folder), RATES, ["event_id"])


@query(
    "corruption_log",
    with_sql(TX, DEGRADED) + """
    SELECT event_id, 'type' AS "column", type AS true_value FROM marked WHERE no_type
    UNION ALL SELECT event_id, 'amount', CAST(round(amount, 4) AS VARCHAR) FROM marked WHERE no_amount""",
)
def corruption_log(spark, folder):
    tx = transactions(spark, folder)
    log = dg.corruption_log(tx, RATES, ["event_id"])
    number = F.round(F.col("true_value").try_cast("double"), 4).cast("string")
    return log.withColumn("true_value", F.when(F.col("column") == "amount", number).otherwise(F.col("true_value")))


@query(
    "repair_accuracy",
    with_sql(TX, DEGRADED) + """
    , filled AS (SELECT type FROM degraded WHERE type IS NOT NULL
                 GROUP BY type ORDER BY count(*) DESC, type LIMIT 1),
    middle AS (SELECT median(amount) AS m FROM degraded)
    SELECT 'type' AS "column", count(*) AS cells, count(*) AS repaired_cells,
           count(*) FILTER (type = (SELECT type FROM filled)) AS exact_cells
    FROM marked WHERE no_type
    UNION ALL
    SELECT 'amount', count(*), count(*), count(*) FILTER (amount = (SELECT m FROM middle))
    FROM marked WHERE no_amount""",
)
def repair_accuracy(spark, folder):
    log = dg.corruption_log(transactions(spark, folder), RATES, ["event_id"])
    fixed = impute_categorical(degraded(spark, folder), ["type"], "most_frequent")
    fixed = impute_numeric(fixed, ["amount"], "median")
    return dg.repair_accuracy(log, fixed.select("event_id", "type", "amount"), ["event_id"])


@query(
    "outlier_counts",
    with_sql(TX) + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(max(a - 1.5 * (b - a)), 6) AS low,
            round(max(b + 1.5 * (b - a)), 6) AS high,
            count(*) FILTER ("{c}" < a - 1.5 * (b - a) OR "{c}" > b + 1.5 * (b - a)) AS outliers,
            round(count(*) FILTER ("{c}" < a - 1.5 * (b - a) OR "{c}" > b + 1.5 * (b - a))
                  / count("{c}")::DOUBLE, 6) AS rate
            FROM tx, (SELECT quantile_cont("{c}"::DOUBLE, 0.25) AS a, quantile_cont("{c}"::DOUBLE, 0.75) AS b FROM tx)"""
        for c in ("event_id", "step", "amount", "isFraud")
    ),
)
def outlier_counts(spark, folder):
    return rounded(pf.outliers(transactions(spark, folder)))


@query(
    "constant_columns",
    with_sql(TX) + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(max(n) / sum(n)::DOUBLE, 6) AS top_share,
            max(n) = sum(n) AS is_constant, max(n) / sum(n)::DOUBLE >= 0.9 AS is_near_constant
            FROM (SELECT count(*) AS n FROM tx GROUP BY "{c}")"""
        for c in ("event_id", "step", "type", "amount", "nameOrig", "nameDest", "isFraud")
    ),
)
def constant_columns(spark, folder):
    tx = transactions(spark, folder)
    return rounded(pf.constant_columns(tx, tx.columns, 0.9))


@query(
    "injected_defects",
    with_sql(TX) + """
    , places AS (
      SELECT event_id, type, amount,
             row_number() OVER (ORDER BY md5('5|amount|' || event_id)) AS ra,
             row_number() OVER (ORDER BY md5('6|type|' || event_id)) AS rt,
             row_number() OVER (ORDER BY md5('7|' || event_id)) AS rd,
             round_even(count(*) OVER () * 0.02, 0) AS n
      FROM tx),
    changed AS (
      SELECT event_id, rd <= n AS twice, CASE WHEN rt <= n THEN 'INVALID' ELSE type END AS type,
             CASE WHEN ra <= n THEN amount * 100 ELSE amount END AS amount
      FROM places)
    SELECT event_id, type, round(amount, 6) AS amount FROM changed
    UNION ALL SELECT event_id, type, round(amount, 6) FROM changed WHERE twice""",
)
def injected_defects(spark, folder):
    key = ["event_id"]
    rows = transactions(spark, folder).select("event_id", "type", "amount")
    rows = dg.inject_extremes(rows, {"amount": 0.02}, key, 100.0, 5)
    rows = dg.inject_invalid_categories(rows, {"type": 0.02}, key, "INVALID", 6)
    return rounded(dg.inject_duplicates(rows, 0.02, key, 7))


@query(
    "injected_wrong_types",
    with_sql(TX) + """
    SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5('8|step|' || event_id))
        <= round_even(count(*) OVER () * 0.02, 0) THEN 'n/a' ELSE CAST(step AS VARCHAR) END AS step
    FROM tx""",
)
def injected_wrong_types(spark, folder):
    rows = transactions(spark, folder).select("event_id", "step")
    return dg.inject_wrong_types(rows, {"step": 0.02}, ["event_id"], "n/a", 8)
