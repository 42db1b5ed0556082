"""Language identification: the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import remainder, slices, written

# Languages that are hard to tell apart; one that is not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro"),
    "slavic": ("ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr"),
}
BINS = 2048
# Learning reads about this many documents of each language at most, chosen by a hash of the id.
FIT_PER_LANGUAGE = 1_500
UNKNOWN = "und"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(raw: bytes) -> np.ndarray:
    """Bins of all two- and three-byte runs of a text in lower case, blanks around it."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint64)
    two = b[:-1] << np.uint64(8) | b[1:]
    three = two[:-1] << np.uint64(8) | b[2:]
    shift = np.uint64(64 - BINS.bit_length() + 1)
    return np.concatenate([two * _ODD >> shift, (three + np.uint64(1 << 24)) * _ODD >> shift])


def _bytes(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def profile(text: str | None) -> np.ndarray:
    """Square roots of the shares of the bins: a vector of length one for any text."""
    n = np.bincount(_grams(_bytes(text)).astype(np.int64), minlength=BINS)
    return np.sqrt(n / n.sum())


@dataclass(frozen=True)
class Machine:
    """A linear SVM that tells `right` (positive margin) from `left`."""

    left: str
    right: str
    weights: np.ndarray
    intercept: float


@dataclass(frozen=True)
class Model:
    """Machines between families, and between the languages of each family."""

    families: dict[str, tuple[str, ...]]
    between: list[Machine]
    inside: dict[str, list[Machine]]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language of a profile and a score from 0 to 1."""
        if not self.families:
            return UNKNOWN, 0.0
        family, sure = _vote(tuple(self.families), self.between, x)
        language, sure_inside = _vote(self.families[family], self.inside[family], x)
        return language, sure * sure_inside


def _vote(names: tuple[str, ...], machines: list[Machine], x: np.ndarray) -> tuple[str, float]:
    """One-versus-one: the name with most votes, by margin if tied; how sure its machines are."""
    votes = dict.fromkeys(names, 0.0)
    sure = dict.fromkeys(names, 1.0)
    for m in machines:
        p = 1 / (1 + np.exp(-3 * float(m.weights @ x + m.intercept)))
        # Margins are under one vote.
        votes[m.right if p >= 0.5 else m.left] += 1 + abs(p - 0.5) / len(machines)
        sure[m.right] = min(sure[m.right], p)
        sure[m.left] = min(sure[m.left], 1 - p)
    best = max(names, key=lambda n: (votes[n], n))
    return best, sure[best]


def _machines(rows: DataFrame, column: str, names: list[str]) -> list[Machine]:
    out = []
    for left, right in combinations(names, 2):
        pair = rows.where(F.col(column).isin(left, right)).select(
            (F.col(column) == right).cast("double").alias("label"), "features"
        )
        # Rescaling by weight keeps a frequent language from outweighing a rare one.
        counts = {r["label"]: r["count"] for r in pair.groupBy("label").count().collect()}
        share = F.when(F.col("label") == 1, 0.5 / counts[1.0]).otherwise(0.5 / counts[0.0])
        weighted = pair.withColumn("weight", share * sum(counts.values()))
        svm = LinearSVC(
            maxIter=20, regParam=1e-4, standardization=False, weightCol="weight", aggregationDepth=2
        ).fit(weighted)
        out.append(Machine(left, right, svm.coefficients.toArray(), float(svm.intercept)))
    return out


def train(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE) -> Model:
    """Learn from text and lang of documents outside the held-out part (crc32 of the id modulo 5 is 0).

    Rows without lang, without a letter in the text or without id are not learned from. About
    `per_language` documents of each language are read at most. One language only is predicted for
    every text; without any, every text is unknown.
    """
    known = docs.select(
        F.col("doc_id").alias("id"), F.col("text").cast("string"), F.col("lang").cast("string")
    ).where("lang IS NOT NULL AND text IS NOT NULL AND text RLIKE '\\\\p{L}'")
    known = known.where(remainder(F.col("id")) != 0)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model({}, [], {})
    family = {code: name for name, codes in FAMILIES.items() for code in codes}
    families: dict[str, tuple[str, ...]] = {}
    for code in languages:
        name = family.get(code, code)
        families[name] = (*families.get(name, ()), code)
    least = F.lit(0.0)
    for code in languages:
        least = F.when(F.col("lang") == code, per_language / counts[code]).otherwise(least)
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < least * 1_000_000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            x = [profile(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(x, pa.list_(pa.float64()))], ["lang", "x"]
            )

    named = F.lit(None).cast("string")
    for name, codes in families.items():
        named = F.when(F.col("lang").isin(*codes), name).otherwise(named)
    profiles = drawn.select("text", "lang").mapInArrow(run, "lang string, x array<double>")
    rows = written(profiles, "language-profiles").select(
        "lang", named.alias("family"), array_to_vector("x").alias("features")
    )
    # The sample is bounded; few parts spare each step of the fit a shuffle of its sums.
    rows = rows.coalesce(4).cache()
    try:
        present = {r["lang"] for r in rows.select("lang").distinct().collect()}
        families = {
            f: kept for f, codes in families.items() if (kept := tuple(c for c in codes if c in present))
        }
        between = _machines(rows, "family", sorted(families))
        inside = {f: _machines(rows, "lang", list(codes)) for f, codes in families.items()}
    finally:
        rows.unpersist()
    return Model(families, between, inside)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document, from its whole text alone.

    `und` with score 0 for a text that is null or has no letter. Repeated rows and null ids are
    predicted like others; other columns are left out. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = [
                model.predict(profile(t)) if has_letter(t) else (UNKNOWN, 0.0)
                for t in part.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([float(f[1]) for f in found], pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
