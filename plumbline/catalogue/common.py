"""Tables and SQL pieces the catalogue shares."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.durability import shared_base

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, its oracle."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """Fresh folder for files a query writes, on the cluster's shared storage if it names one."""
    return f"{shared_base(spark)}/{name}-{uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round doubles, which engines sum in different orders, and widen whole numbers."""
    out: dict[str, Column] = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float") and name not in skip:
            # Adding 0.0 turns a rounded -0.0 into 0.0.
            out[name] = F.round(F.col(f"`{name}`"), digits) + F.lit(0.0)
        elif kind in ("tinyint", "smallint", "int"):
            out[name] = F.col(f"`{name}`").cast("long")
    return df.withColumns(out) if out else df


FRAUD_AMOUNT = 150

# Kinds of events as kinds of transactions.
EVENT_TYPES = {
    "view": "PAYMENT",
    "click": "TRANSFER",
    "purchase": "CASH_OUT",
    "signup": "CASH_IN",
    "error": "DEBIT",
}


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The events seen as transactions; large values are the rare positive class."""
    names = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    return table(spark, folder, "events").select(
        "event_id",
        (
            F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)") + 1
        ).cast("long").alias("step"),
        names[F.col("event_type")].alias("type"),
        F.col("value").alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        F.concat(
            F.when(F.col("event_type").isin("purchase", "view"), "M").otherwise("C"),
            F.col("user_id").cast("string"),
        ).alias("nameDest"),
        (F.col("value") >= FRAUD_AMOUNT).cast("long").alias("isFraud"),
    )


TX = """
tx AS (
  SELECT event_id,
         date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) + 1 AS step,
         CASE event_type WHEN 'view' THEN 'PAYMENT' WHEN 'click' THEN 'TRANSFER'
              WHEN 'purchase' THEN 'CASH_OUT' WHEN 'signup' THEN 'CASH_IN'
              WHEN 'error' THEN 'DEBIT' END AS type,
         value AS amount,
         'C' || user_id AS "nameOrig",
         (CASE WHEN event_type IN ('purchase', 'view') THEN 'M' ELSE 'C' END) || user_id
           AS "nameDest",
         CAST(value >= 150 AS BIGINT) AS "isFraud"
  FROM events
)"""

FEATURES = """
features AS (
  SELECT event_id, step, type, amount, "nameDest", "isFraud",
         ((step - 1) % 24 + 24) % 24 AS hour,
         CAST(floor((step - 1) / 24.0) AS BIGINT) AS day,
         ln(1 + amount) AS log_amount,
         CAST(type = 'TRANSFER' AS BIGINT) AS is_transfer,
         CAST(type = 'CASH_OUT' AS BIGINT) AS is_cash_out,
         CAST(starts_with("nameDest", 'M') AS BIGINT) AS is_merchant_destination
  FROM tx
)"""

RATES = {"amount": 0.05, "type": 0.10}

DEGRADED = """
marked AS (
  SELECT *,
         row_number() OVER (ORDER BY md5('42|amount|' || event_id))
           <= (SELECT greatest(1, round_even(count(*) * 0.05, 0)) FROM tx) AS no_amount,
         row_number() OVER (ORDER BY md5('42|type|' || event_id))
           <= (SELECT greatest(1, round_even(count(*) * 0.10, 0)) FROM tx) AS no_type
  FROM tx
),
degraded AS (
  SELECT event_id, step, CASE WHEN no_type THEN NULL ELSE type END AS type,
         CASE WHEN no_amount THEN NULL ELSE amount END AS amount, "isFraud"
  FROM marked
)"""

FOLDS = """
copies AS (SELECT event_id, "isFraud", amount, step, r AS repeat
           FROM tx, (SELECT unnest([1, 2]) AS r)),
folds AS (
  SELECT event_id, "isFraud", amount, step, CAST(repeat AS BIGINT) AS repeat,
         (row_number() OVER (PARTITION BY repeat, "isFraud"
            ORDER BY md5('42|' || repeat || '|' || event_id)) - 1) % 5 + 1 AS fold
  FROM copies
)"""

SCORED = """
scored AS (
  SELECT l.doc_id, d.lang, d.source, l.toxic AS y_true, (d.n_chars % 101) / 100.0::DOUBLE AS y_score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


def degraded(spark: SparkSession, folder: str) -> DataFrame:
    from plumbline.operators.degrade import degrade

    rows = transactions(spark, folder).drop("nameOrig", "nameDest")
    return degrade(rows, RATES, ["event_id"], 42, ["isFraud"])


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity labels with a score made from the length of the document."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return (
        table(spark, folder, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            "lang",
            "source",
            F.col("toxic").alias("y_true"),
            ((F.col("n_chars") % 101) / 100.0).alias("y_score"),
        )
    )


def with_sql(*parts: str) -> str:
    """Common table expressions; the statement itself follows."""
    return "WITH " + ",".join(parts) + "\n"
