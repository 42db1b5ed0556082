"""Benchmark decontamination by winnowing, in built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import ascii_lower

WINDOW = 10
GRAM = 5
# Every window holds so many grams; the smallest is its fingerprint.
GRAMS = WINDOW - GRAM + 1
# Windows of benchmark items that are broadcast at once; more are joined in blocks of this size.
BLOCK = 200_000


def item_words(text: Column) -> Column:
    """Runs of digits, a-z (A-Z in lower case) and characters beyond ASCII."""
    cut = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.array_remove(cut, "")


def _gram(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(GRAM)])


def _word_key(word: Column) -> Column:
    return F.xxhash64(F.lit("word"), word)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(key, at, win, items): distinct windows with their fingerprint and its place in the window.

    An item of fewer than ten words is one window; its key is that of its longest word.
    """
    item = benchmark.select(
        F.col("item_id").cast("string").alias("item"),
        item_words(F.col("text").cast("string")).alias("w"),
    ).where(F.size("w") > 0)
    starts = item.where(F.size("w") >= WINDOW).select(
        "item", "w", F.explode(F.sequence(F.lit(0), F.size("w") - WINDOW)).alias("s")
    )
    grams = F.transform(
        F.sequence(F.lit(0), F.lit(GRAMS - 1)), lambda k: _gram(F.col("w"), F.col("s") + k)
    )
    whole = starts.withColumn("g", grams).select(
        "item",
        F.array_min("g").alias("key"),
        (F.array_position("g", F.array_min("g")) - 1).cast("int").alias("at"),
        F.slice("w", F.col("s") + 1, WINDOW).alias("win"),
    )
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    short = item.where(F.size("w") < WINDOW).withColumn("a", longest["x"]).select(
        "item",
        _word_key(F.col("a")).alias("key"),
        (F.array_position("w", F.col("a")) - 1).cast("int").alias("at"),
        F.col("w").alias("win"),
    )
    return whole.union(short).groupBy("key", "at", "win").agg(F.collect_set("item").alias("items"))


def _keys(short: bool) -> Column:
    """Fingerprints of the row's windows and, if there are short items, keys of its words."""
    grams, words = F.col("grams"), F.col("words")
    minima = F.transform(
        F.slice(grams, 1, F.size(grams) - GRAMS + 1),
        lambda g, i: F.least(g, *[F.get(grams, i + k) for k in range(1, GRAMS)]),
    )
    empty = F.array().cast("array<bigint>")
    keys = F.when(F.size(grams) >= GRAMS, F.array_distinct(minima)).otherwise(empty)
    if short:
        keys = F.concat(keys, F.transform(F.array_distinct(words), _word_key))
    # The null keeps one row of each document.
    return F.concat(keys, F.array(F.lit(None).cast("bigint")))


def _found(row_windows: Column) -> Column:
    """Windows that stand in the document where its grams or words have the key: extended hits."""
    words, grams, key = F.col("words"), F.col("grams"), F.col("key")

    def places(hashes: Column) -> Column:
        marked = F.transform(hashes, lambda h, p: F.when(h == key, p))
        return F.filter(marked, lambda p: p.isNotNull())

    # Words are hashed only in rows whose key is that of a word.
    by_word = F.exists(row_windows, lambda x: F.size(x["win"]) < WINDOW)
    by_gram = F.exists(row_windows, lambda x: F.size(x["win"]) == WINDOW)
    none = F.array().cast("array<int>")
    at = F.array_union(
        F.when(by_word, places(F.transform(words, _word_key))).otherwise(none),
        F.when(by_gram, places(grams)).otherwise(none),
    )

    def stands(p: Column, x: Column) -> Column:
        start = p - x["at"]
        return F.when(start >= 0, F.slice(words, start + 1, F.size(x["win"])) == x["win"])

    hits = F.transform(
        at,
        lambda p: F.transform(
            F.filter(row_windows, lambda x: stands(p, x)),
            lambda x: F.struct(
                (p - x["at"]).alias("start"),
                F.size(x["win"]).alias("length"),
                x["items"].alias("items"),
            ),
        ),
    )
    return F.flatten(hits)


def spans(docs: DataFrame, benchmark: DataFrame, keep_all: bool = True) -> DataFrame:
    """Documents (doc_id, text) with what they share with items (item_id, text).

    Columns: doc_id, text_hash, n_words, n_hit (words inside any shared window), spans
    (array of start and length), items (sorted ids, as text). A window is ten words; an item of
    fewer words is one window. Both sides keep the smallest hash of a five-word gram in each window,
    so a shared window has a fingerprint in common, and fingerprints that meet are extended to the
    windows around them, compared word by word. Documents aren't shuffled: the item windows come in
    blocks of bounded size.

    One row for each row of `docs`, or with keep_all=False for each that has a hit. Null and empty
    texts have no words; items without words are in no document. An item without id marks words but
    is not listed. Repeated documents are judged row by row; repeated items are listed each. Other
    columns are left out. An empty benchmark hits nothing.
    """
    windows = item_windows(benchmark)
    sizes = windows.agg(
        F.count("*").alias("n"), F.min(F.size("win")).alias("least")
    ).first()
    short = (sizes["least"] or WINDOW) < WINDOW
    blocks = max(1, -(-sizes["n"] // BLOCK))
    words = F.col("words")
    text = F.col("text").cast("string")
    cut = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        item_words(text).alias("words"),
    )
    grams = F.when(
        F.size(words) >= GRAM,
        F.transform(
            F.slice(words, 1, F.size(words) - GRAM + 1),
            lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, GRAM)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = cut.withColumn("grams", grams).withColumn("keys", _keys(short))

    def block(k: int) -> DataFrame:
        own = windows if blocks == 1 else windows.where(F.pmod(F.col("key"), F.lit(blocks)) == k)
        by_key = own.groupBy("key").agg(F.collect_list(F.struct("at", "win", "items")).alias("wins"))
        # Not explode(): its inferred filter would be pushed down and compute the keys anew.
        met = rows.withColumn("key", F.explode_outer("keys")).drop("keys")
        met = met.join(F.broadcast(by_key), "key", "left").where("wins IS NOT NULL OR key IS NULL")
        found = F.when(F.col("wins").isNotNull(), _found(F.col("wins")))
        return met.select(
            "row", "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"),
            found.alias("found"),
        )

    met = reduce(DataFrame.union, [block(k) for k in range(blocks)])
    found = F.array_distinct(F.flatten("hits"))
    # A filter on hits may stand behind this aggregate only: pushed into the join, it would keep the
    # join from running in one compiled stage with the explosion of keys.
    per_row = met.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_hash").alias("text_hash"),
        F.first("n_words").alias("n_words"),
        F.collect_list("found").alias("hits"),
    ).select("doc_id", "text_hash", "n_words", found.alias("hits"))
    if not keep_all:
        per_row = per_row.where(F.size("hits") > 0)
    places = F.array_sort(
        F.array_distinct(F.transform("hits", lambda x: F.struct(x["start"], x["length"])))
    )
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(x["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], x["start"] + x["length"]).alias("end"),
        ),
        lambda a: a["n"].cast("long"),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    return per_row.select("doc_id", "text_hash", "n_words", places.alias("spans"), items.alias("items")).select(
        "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), "spans", "items"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns.

    A verdict belongs to an id and a text, so rows without id are told apart by their text.
    """
    bad = spans(docs, benchmark, keep_all=False).select(
        F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_text")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (
        F.xxhash64(F.col("text").cast("string")) == F.col("_bad_text")
    )
    return docs.join(bad.distinct(), same, "left_anti")
