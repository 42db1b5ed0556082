"""What the operators of this package share: text expressions, folders, bounded work units."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from tempfile import mkdtemp
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other letter stays."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Runs of characters other than blank and \\t-\\r; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def remainder(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    A session on a local master that names none gets a temporary folder; elsewhere it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share")
        base = mkdtemp(prefix="plumbline-llm-")
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe from lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slices(batches: Iterable[pa.RecordBatch], weight: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `most` bytes in column `weight`, or one row."""
    for batch in batches:
        n = batch.num_rows
        size = batch.column(weight).nbytes if n else 0
        step = max(1, int(n * most / max(size, 1)))
        for k in range(0, n, step):
            yield batch.slice(k, step)


def crc_remainder(doc_id, parts: int = 5) -> int:
    """`remainder` for one value in a task; -1 for a null id, which is in no part."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def one_thread() -> None:
    """Tasks are Spark's unit of parallel work; libraries inside them use one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
