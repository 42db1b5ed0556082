"""Documents to packed training sequences, in stages that each call one operator.

Each stage works on all that its predecessor kept and returns the columns of the documents; the last
one returns pieces of sequences. A stage's result is a Parquet table in the shared folder, so a lost
executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, near_dup, packing, quality_gam, quality_rules
from plumbline.llm.shared import written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from `labels`.

    Every row is scored by itself, whole texts however long: equal rows fare alike, null and empty
    texts are scored as empty ones, rows without id are scored and not learned from. Without labels
    of both kinds all stay; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_gam.keep(docs, quality_gam.train(docs, labels))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the table of quality rules.

    Every row is judged by itself, on its whole text; null, empty and blank texts have too few
    words and go. An empty table stays empty.
    """
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: similarity 0.8 or more on five-word shingles.

    The row with the smallest id stays, rows without id last; of equal rows, and of rows of one id
    in one group, a single one. Texts without words are in no group and stay. An empty table stays
    empty.
    """
    return near_dup.keep(docs, percent=80, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item.

    Every row is judged by itself, on its whole text; texts without words share nothing and stay.
    Without benchmark items all stay; an empty table stays empty.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens.

    Every row is packed, equal ones each; a null or empty text is its end token, a very long one
    gives many pieces. An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Trained scores, near duplicates and tokens are beyond SQL; tests hold the stages that decide by rule
# against plain Python, and the classifier's against its scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
