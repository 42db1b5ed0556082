"""Queries on samples, folds, class balance and column transformations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.catalogue.common import (
    DEGRADED,
    FOLDS,
    TX,
    degraded,
    query,
    rounded,
    table,
    transactions,
    with_sql,
)
from plumbline.functions.durability import durable
from plumbline.operators import folds as fd
from plumbline.operators import sampling as sp
from plumbline.operators import transforms as tr
from plumbline.operators.categories import assembled, one_hot_sparse
from plumbline.operators.neighbours import nearest_neighbours, smote

KEY = ["event_id"]


@query(
    "exact_sample",
    """SELECT o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (ORDER BY md5('7|' || o_orderkey)) <= 1000""",
)
def exact_sample(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sp.exact_sample(orders, ["o_orderkey"], 1000, 7)


@query(
    "case_control_sample",
    with_sql(TX) + """
    SELECT event_id, amount, "isFraud" FROM tx WHERE "isFraud" = 1
    UNION ALL
    SELECT event_id, amount, "isFraud" FROM tx WHERE "isFraud" = 0
    QUALIFY row_number() OVER (ORDER BY md5('42|' || event_id))
      <= 10 * (SELECT count(*) FROM tx WHERE "isFraud" = 1)""",
)
def case_control_sample(spark, folder):
    tx = transactions(spark, folder).select("event_id", "amount", "isFraud")
    return sp.case_control_sample(tx, "isFraud", KEY, 10, 42)


@query(
    "seeded_shuffle",
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS place
       FROM orders""",
)
def seeded_shuffle(spark, folder):
    # Places in the shuffled order: rows before the partition, then the place inside it.
    orders = sp.shuffled(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 42)
    at = orders.withColumn("at", F.monotonically_increasing_id())
    at = at.withColumns({"part": F.expr("at >> 33"), "inside": F.expr("at & ((1L << 33) - 1)")})
    sizes = at.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return at.join(F.broadcast(starts), "part").select(
        "o_orderkey", (F.col("start") + F.col("inside") + 1).alias("place")
    )


@query(
    "union_of_sides",
    """SELECT l_linestatus AS side, l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem""",
)
def union_of_sides(spark, folder):
    items = table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("side"), "l_orderkey", "l_linenumber"
    )
    return rounded(items.where("side = 'O'").unionByName(items.where("side <> 'O'")))


def _assigned(spark, folder):
    tx = transactions(spark, folder)
    return tx, fd.stratified_folds(tx, "isFraud", KEY, 5, 2, 42)


@query(
    "stratified_folds",
    with_sql(TX, FOLDS) + """SELECT event_id, "isFraud", repeat, fold FROM folds""",
)
def stratified_folds(spark, folder):
    return rounded(_assigned(spark, folder)[1])


@query(
    "fold_membership",
    with_sql(TX, FOLDS) + """
    SELECT f.repeat, v.fold,
           count(*) FILTER (f.fold <> v.fold) AS train_rows,
           count(*) FILTER (f.fold <> v.fold AND "isFraud" = 1) AS train_positives,
           count(*) FILTER (f.fold = v.fold) AS validation_rows,
           count(*) FILTER (f.fold = v.fold AND "isFraud" = 1) AS validation_positives
    FROM folds f, (SELECT DISTINCT fold FROM folds) v GROUP BY 1, 2""",
)
def fold_membership(spark, folder):
    assigned = _assigned(spark, folder)[1].withColumnRenamed("isFraud", "target")
    return rounded(fd.fold_membership(assigned, 5))


@query(
    "fold_training_rows",
    with_sql(TX, FOLDS) + """
    SELECT event_id, repeat, v.fold, folds.fold = v.fold AS held_out
    FROM folds, (SELECT DISTINCT fold FROM folds) v""",
)
def fold_training_rows(spark, folder):
    """Training and validation rows of every fold of every repeat."""
    assigned = durable(_assigned(spark, folder)[1])
    parts = [
        side(assigned, repeat, fold).select(
            "event_id", F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), F.lit(held).alias("held_out")
        )
        for repeat in (1, 2)
        for fold in (1, 2, 3, 4, 5)
        for side, held in ((fd.training_rows, False), (fd.validation_rows, True))
    ]
    return rounded(reduce(DataFrame.unionAll, parts))


@query(
    "target_fingerprint",
    with_sql(TX) + """
    SELECT count(*) AS rows,
           bit_xor(('0x' || substr(md5(event_id || '|' || "isFraud"), 1, 15))::BIGINT) AS fingerprint
    FROM tx""",
)
def target_fingerprint(spark, folder):
    return fd.target_fingerprint(transactions(spark, folder), "isFraud", KEY)


@query(
    "undersample",
    with_sql(TX) + """
    SELECT event_id, "isFraud" FROM tx WHERE "isFraud" = 1
    UNION ALL SELECT event_id, "isFraud" FROM tx WHERE "isFraud" = 0
    QUALIFY row_number() OVER (ORDER BY md5('42|' || event_id))
      <= (SELECT count(*) FROM tx WHERE "isFraud" = 1)""",
)
def undersample(spark, folder):
    tx = transactions(spark, folder).select("event_id", "isFraud")
    return sp.undersample(tx, "isFraud", KEY, 42)


SIZES = """
sizes AS (SELECT count(*) FILTER ("isFraud" = 1) AS m, count(*) FILTER ("isFraud" = 0) AS n FROM tx),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || event_id)) - 1 AS rank
           FROM tx WHERE "isFraud" = 1)"""


@query(
    "oversample",
    with_sql(TX, SIZES) + """
    , picks AS (
      SELECT ('0x' || substr(md5('42|extra|' || i), 1, 15))::BIGINT % (SELECT m FROM sizes) AS rank
      FROM (SELECT unnest(range((SELECT n - m FROM sizes))) AS i))
    SELECT event_id, "isFraud", count(*) AS copies FROM (
      SELECT event_id, "isFraud" FROM tx
      UNION ALL SELECT r.event_id, r."isFraud" FROM picks p JOIN ranked r ON p.rank = r.rank)
    GROUP BY 1, 2""",
)
def oversample(spark, folder):
    tx = transactions(spark, folder).select("event_id", "isFraud")
    rows = sp.oversample(tx, "isFraud", KEY, 42)
    return rows.groupBy("event_id", "isFraud").agg(F.count("*").alias("copies"))


@query(
    "class_weights",
    with_sql(TX) + """
    SELECT "isFraud" AS "class", count(*) AS rows,
           round((SELECT count(*) FROM tx) / (2.0 * count(*)), 6) AS weight
    FROM tx GROUP BY 1""",
)
def class_weights(spark, folder):
    return rounded(sp.class_weights(transactions(spark, folder), "isFraud"))


@query(
    "weighted_rows",
    """SELECT doc_id, round((SELECT count(*) FROM labels) / (2.0 * n), 6) AS weight
       FROM labels JOIN (SELECT toxic AS t, count(*) AS n FROM labels GROUP BY 1) ON toxic = t""",
)
def weighted_rows(spark, folder):
    rows = sp.add_class_weights(table(spark, folder, "labels"), "toxic")
    return rounded(rows.select("doc_id", "weight"))


@query(
    "nearest_neighbours_embeddings",
    """WITH pairs AS (
         SELECT a.vec_id, b.vec_id AS neighbour,
                sqrt(list_sum(list_transform(range(1, 65),
                  lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS distance
         FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
       SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS place,
              neighbour, round(distance, 6) AS distance
       FROM pairs QUALIFY place <= 5""",
)
def nearest_neighbours_embeddings(spark, folder):
    return rounded(
        nearest_neighbours(table(spark, folder, "embeddings"), "vec_id", "embedding", 5)
    )


@query(
    "smote_events",
    with_sql(TX, SIZES) + """
    , pairs AS (
      SELECT a.event_id, b.event_id AS neighbour, row_number() OVER (PARTITION BY a.event_id
        ORDER BY sqrt(power(a.step - b.step, 2) + power(a.amount - b.amount, 2)), b.event_id)
        AS place
      FROM ranked a JOIN ranked b ON a.event_id <> b.event_id QUALIFY place <= 5),
    picks AS (
      SELECT i, ('0x' || substr(md5('42|base|' || i), 1, 15))::BIGINT % (SELECT m FROM sizes) AS rank,
             ('0x' || substr(md5('42|neighbour|' || i), 1, 15))::BIGINT % 5 + 1 AS place,
             ('0x' || substr(md5('42|place|' || i), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u
      FROM (SELECT unnest(range((SELECT n - m FROM sizes))) AS i))
    SELECT event_id, "isFraud", step::DOUBLE AS step, round(amount, 6) AS amount FROM tx
    UNION ALL
    SELECT -1, 1, round(a.step + u * (b.step - a.step), 6),
           round(a.amount + u * (b.amount - a.amount), 6)
    FROM picks k JOIN ranked a ON k.rank = a.rank
    JOIN pairs p ON p.event_id = a.event_id AND p.place = k.place
    JOIN ranked b ON b.event_id = p.neighbour""",
)
def smote_events(spark, folder):
    tx = transactions(spark, folder).select("event_id", "isFraud", "step", "amount")
    rows = smote(tx, "isFraud", KEY, ["step", "amount"])
    return rounded(rows.withColumn("event_id", F.coalesce("event_id", F.lit(-1))))


@query(
    "impute_numeric_median",
    with_sql(TX, DEGRADED) + """
    SELECT event_id, round(coalesce(amount, (SELECT median(amount) FROM degraded)), 6) AS amount
    FROM degraded""",
)
def impute_numeric_median(spark, folder):
    rows = degraded(spark, folder).select("event_id", "amount")
    return rounded(tr.impute_numeric(rows, ["amount"], "median"))


@query(
    "impute_numeric_mean",
    with_sql(TX, DEGRADED) + """
    SELECT event_id, round(coalesce(amount, (SELECT avg(amount) FROM degraded)), 6) AS amount
    FROM degraded""",
)
def impute_numeric_mean(spark, folder):
    rows = degraded(spark, folder).select("event_id", "amount")
    return rounded(tr.impute_numeric(rows, ["amount"], "mean"))


@query(
    "impute_categorical_mode",
    with_sql(TX, DEGRADED) + """
    SELECT event_id, coalesce(type, (SELECT type FROM degraded WHERE type IS NOT NULL
      GROUP BY type ORDER BY count(*) DESC, type LIMIT 1)) AS type FROM degraded""",
)
def impute_categorical_mode(spark, folder):
    rows = degraded(spark, folder).select("event_id", "type")
    return tr.impute_categorical(rows, ["type"], "most_frequent")


@query(
    "impute_categorical_constant",
    with_sql(TX, DEGRADED) + "SELECT event_id, coalesce(type, 'MISSING') AS type FROM degraded",
)
def impute_categorical_constant(spark, folder):
    rows = degraded(spark, folder).select("event_id", "type")
    return tr.impute_categorical(rows, ["type"], "constant", "MISSING")


@query(
    "scale_standard",
    """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6)
         AS c_acctbal FROM customer""",
)
def scale_standard(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return rounded(tr.scale_numeric(rows, ["c_acctbal"], "standard"))


@query(
    "scale_robust",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
         round((l_extendedprice - q[2]) / (q[3] - q[1]), 6) AS l_extendedprice
       FROM lineitem, (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)""",
)
def scale_robust(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    return rounded(tr.scale_numeric(rows, ["l_extendedprice"], "robust"))


@query(
    "log_transform",
    "SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS o_totalprice FROM orders",
)
def log_transform(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rounded(tr.log_transform(rows, ["o_totalprice"]), 9)


@query(
    "one_hot",
    with_sql(TX, DEGRADED) + """
    SELECT event_id, CAST(type IS NULL AS BIGINT) AS "type=__NULL__",
           CAST(coalesce(type, '') = 'CASH_IN' AS BIGINT) AS "type=CASH_IN",
           CAST(coalesce(type, '') = 'CASH_OUT' AS BIGINT) AS "type=CASH_OUT",
           CAST(coalesce(type, '') = 'DEBIT' AS BIGINT) AS "type=DEBIT",
           CAST(coalesce(type, '') = 'PAYMENT' AS BIGINT) AS "type=PAYMENT",
           CAST(coalesce(type, '') = 'TRANSFER' AS BIGINT) AS "type=TRANSFER"
    FROM degraded""",
)
def one_hot(spark, folder):
    rows = degraded(spark, folder).select("event_id", "type")
    return rounded(tr.one_hot_encode(rows, ["type"]))


@query(
    "one_hot_unseen",
    with_sql(TX) + """
    SELECT event_id, CAST(type = 'CASH_OUT' AS BIGINT) AS "type=CASH_OUT",
           CAST(type = 'PAYMENT' AS BIGINT) AS "type=PAYMENT"
    FROM tx""",
)
def one_hot_unseen(spark, folder):
    rows = transactions(spark, folder).select("event_id", "type", "nameDest")
    merchants = rows.where(F.col("nameDest").startswith("M"))
    return rounded(tr.one_hot_encode(rows, ["type"], merchants).drop("nameDest"))


_MANY = """
    lines AS (SELECT l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber AS line,
                     CASE WHEN l_quantity >= 5 THEN l_returnflag END AS mode FROM lineitem),
    learned AS (SELECT * FROM lines WHERE {0}),
    line_ids AS (SELECT v, row_number() OVER (ORDER BY v IS NOT NULL, md5(v)) - 1 AS i
                 FROM (SELECT DISTINCT line AS v FROM learned)),
    mode_ids AS (SELECT v, row_number() OVER (ORDER BY v IS NOT NULL, md5(v)) - 1 AS i
                 FROM (SELECT DISTINCT mode AS v FROM learned))
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
           (SELECT count(*) FROM line_ids) + (SELECT count(*) FROM mode_ids) AS size,
           concat_ws(',', a.i, b.i + (SELECT count(*) FROM line_ids)) AS positions
    FROM lines LEFT JOIN line_ids a ON line IS NOT DISTINCT FROM a.v
    LEFT JOIN mode_ids b ON mode IS NOT DISTINCT FROM b.v"""


def _encoded_lines(spark, folder, learned):
    """Lines by a text of their own, one category each, and by a way of shipping that is missing at times."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"),
        F.when(F.col("l_quantity") >= 5, F.col("l_returnflag")).alias("mode"),
    )
    encoded = one_hot_sparse(lines, ["line", "mode"], lines.where(learned))
    whole = assembled(encoded, ["line", "mode"], "vector")
    cells = F.unwrap_udt("vector")
    return rounded(
        whole.select(
            "l_orderkey",
            "l_linenumber",
            cells["size"].alias("size"),
            F.array_join(cells["indices"].cast("array<string>"), ",").alias("positions"),
        )
    )


@query("one_hot_many", "WITH" + _MANY.format("true"))
def one_hot_many(spark, folder):
    """As many categories as there are lines, as sparse vectors."""
    return _encoded_lines(spark, folder, F.lit(True))


@query("one_hot_many_unseen", "WITH" + _MANY.format("l_linenumber <= 3 AND mode <> 'A'"))
def one_hot_many_unseen(spark, folder):
    """The same, with categories that were not learned, a missing one among them."""
    return _encoded_lines(spark, folder, "l_linenumber <= 3 AND mode <> 'A'")


@query(
    "fold_local_stats",
    with_sql(TX, FOLDS) + """
    SELECT 'amount' AS "column", f.repeat, v.fold, count(*) AS train_rows,
           round(avg(amount), 9) AS mean, round(stddev_pop(amount), 9) AS std,
           round(quantile_cont(amount, 0.25), 9) AS q25, round(median(amount), 9) AS median,
           round(quantile_cont(amount, 0.75), 9) AS q75
    FROM folds f JOIN (SELECT DISTINCT fold FROM folds) v ON f.fold <> v.fold GROUP BY 2, 3
    UNION ALL
    SELECT 'step', f.repeat, v.fold, count(*), round(avg(step), 9), round(stddev_pop(step), 9),
           round(quantile_cont(step::DOUBLE, 0.25), 9), round(median(step::DOUBLE), 9),
           round(quantile_cont(step::DOUBLE, 0.75), 9)
    FROM folds f JOIN (SELECT DISTINCT fold FROM folds) v ON f.fold <> v.fold GROUP BY 2, 3""",
)
def fold_local_stats(spark, folder):
    tx, assigned = _assigned(spark, folder)
    rows = tx.select("event_id", "amount", "step").join(assigned.drop("isFraud"), "event_id")
    return rounded(tr.fold_statistics(rows, ["amount", "step"], 5), 9)
