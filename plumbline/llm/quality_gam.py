"""Quality classifier: an additive model of binned features with pairwise interactions."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm.shared import remainder, slices

# Fitting reads about this many labelled rows at most, chosen by a hash of their id.
FIT_ROWS = 12_000
BINS = 32
ROUNDS = 150
PAIRS = 6
RATE = 0.15

FEATURES = (
    "log_words", "word_length", "word_spread", "symbol_ratio", "upper_ratio", "digit_ratio",
    "stop_ratio", "shout_ratio", "distinct_ratio", "line_repeat", "top_word", "line_words",
    "punct_ratio", "space_ratio", "odd_ratio", "compressed", "sentence_ratio", "at_ratio",
)

_SYMBOLS = b"#*$%&|<>{}[]=+~^_\\/@"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PUNCT = b".,;:?'\"()-"
_STOPS = frozenset(
    w.encode()
    for w in (
        "the be to of and that have with a in is it for on as was are by at this or from an not "
        "der die und das von zu mit sich auf im dem nicht ein eine als auch den des de la le et "
        "les en un une du que est pour qui dans par sur pas plus au el los las y del se por con"
    ).split()
)
_SENTENCE = re.compile(rb"[.!?](?:\s|$)")


def features(text: str | None) -> list[float]:
    """Numbers that describe the whole text, in the order of FEATURES; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(raw)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lower = raw.lower().split()
    unique: dict[bytes, int] = {}
    for w in lower:
        unique[w] = unique.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]

    def share(marks: bytes) -> float:
        return (size - len(raw.translate(None, marks))) / size

    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        share(_SYMBOLS),
        share(_UPPER),
        share(_DIGITS),
        sum(unique.get(w, 0) for w in _STOPS) / n,
        raw.count(b"!") / n,
        len(unique) / n,
        1 - len(set(lines)) / len(lines),
        max(unique.values()) / n,
        n / len(lines),
        share(_PUNCT),
        (size - lengths.sum()) / size,
        (size - len(raw.decode("utf-8", "surrogatepass"))) / size,
        len(zlib.compress(raw, 1)) / size,
        len(_SENTENCE.findall(raw)) / n,
        raw.count(b"@") / n + raw.count(b"http") / n,
    ]


@dataclass(frozen=True)
class Model:
    """Cut points per feature, a table per feature, and a table per pair of coarse features."""

    cuts: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: one addition per feature and pair."""
        bins = binned(x, self.cuts)
        total = np.full(len(x), self.base)
        for f in range(bins.shape[1]):
            total += self.tables[f][bins[:, f]]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[:, f] >> 2, bins[:, g] >> 2]
        return 1 / (1 + np.exp(-total))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], axis=1)


def _step(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Best piecewise constant update over ordered bins with a few leaves: a shallow tree."""
    edges = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gl, hl = cg[:-1], ch[:-1]
            gr, hr = cg[-1] - gl, ch[-1] - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            gain[(hl < 0.5) | (hr < 0.5)] = 0
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), a + k + 1))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting: each round updates every feature's table in turn, then the pairs."""
    y = y.astype(float)
    n_features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)] if len(x) else [np.zeros(0)] * n_features
    rate = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    tables = np.zeros((n_features, BINS))
    if not len(x) or y.min() == y.max():
        return Model(cuts, tables, [], np.zeros((0, BINS // 4, BINS // 4)), base)
    bins = binned(x, cuts)
    total = np.full(len(y), base)
    sums = lambda ids, v, size: np.bincount(ids, v, size)
    for _ in range(ROUNDS):
        for f in range(n_features):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _step(
                sums(bins[:, f], y - p, BINS), sums(bins[:, f], p * (1 - p), BINS)
            )
            tables[f] += step
            total += step[bins[:, f]]
    side = BINS // 4
    coarse = bins >> 2
    p = 1 / (1 + np.exp(-total))
    gains = []
    for f in range(n_features):
        for g in range(f + 1, n_features):
            cell = coarse[:, f] * side + coarse[:, g]
            gain = sums(cell, y - p, side**2) ** 2 / (sums(cell, p * (1 - p), side**2) + 1)
            gains.append((float(gain.sum()), f, g))
    pairs = [(f, g) for _, f, g in sorted(gains, reverse=True)[:PAIRS]]
    pair_tables = np.zeros((len(pairs), side, side))
    for _ in range(ROUNDS // 3):
        for k, (f, g) in enumerate(pairs):
            p = 1 / (1 + np.exp(-total))
            cell = coarse[:, f] * side + coarse[:, g]
            grad, hess = sums(cell, y - p, side**2), sums(cell, p * (1 - p), side**2)
            # A tree of depth two on the pair: the best cut of one side, then of the other.
            step = RATE * _cells(grad.reshape(side, side), hess.reshape(side, side))
            pair_tables[k] += step
            total += step[coarse[:, f], coarse[:, g]]
    return Model(cuts, tables, pairs, pair_tables, base)


def _cells(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    first = _step(g.sum(axis=1), h.sum(axis=1), leaves=2)
    out = np.zeros_like(g)
    for value in np.unique(first):
        rows = first == value
        out[rows] = _step(g[rows].sum(axis=0), h[rows].sum(axis=0), leaves=2)
    return out


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        rows = [features(t) for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"]
        )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled documents outside the held-out part (crc32 of the id modulo 5 is 0).

    `labels` has doc_id and the label, 0 or 1. Several labels of a document count by their mean, at
    least a half being 1. At most about `fit_rows` rows are read, in the order of a hash of the id.
    Rows without id or label are not learned from. Without rows, or with one class, the model gives
    the rate of label 1 (a half if there is none).
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y"))
        .where(F.col("_y").isNotNull() & (remainder(F.col("_id")) != 0))
        .groupBy("_id")
        .agg((F.avg("_y") >= 0.5).cast("double").alias("_y"))
    )
    share = fit_rows / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    # The sample is bounded by fit_rows, so it may go to every executor.
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    rows = (
        texts.join(F.broadcast(known), "_id")
        .select("_y", "_text")
        .mapInArrow(_describe, "y double, x array<double>")
        .toPandas()
    )
    x = np.array(rows.x.tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows.y.to_numpy()))
    return fit(x[order], rows.y.to_numpy()[order])


def classify(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Columns of the documents (`carry`, all by default) with a score from 0 to 1 behind them.

    Every text is scored whole and by itself; null and empty texts get the score of empty ones. The
    score's column is the last one, whatever the others are called. An empty table gives no rows.
    """
    carry = docs.columns if carry is None else carry
    fields = docs.select(*[F.col(f"`{c}`") for c in carry]).schema.fields
    places = [f"c{k}" for k in range(len(fields))]
    kinds = [StructField(p, f.dataType) for p, f in zip(places, fields, strict=True)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            x = np.array([features(t) for t in part.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            own = part.columns[1:] if "text" not in carry else [
                part.column(0) if c == "text" else part.column(1 + k)
                for k, c in enumerate(carry)
            ]
            yield pa.RecordBatch.from_arrays([*own, pa.array(model.score(x))], [*places, "score"])

    held = docs.select(
        F.col("text").cast("string").alias("t"),
        *[
            (F.lit(None).cast("string") if c == "text" else F.col(f"`{c}`")).alias(p)
            for c, p in zip(carry, places, strict=True)
        ],
    )
    scored = held.mapInArrow(run, StructType([*kinds, StructField("score", DoubleType())]))
    return scored.toDF(*carry, "score")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    names = docs.columns
    scored = classify(docs, model).toDF(*[f"c{k}" for k in range(len(names))], "score")
    return scored.where(F.col("score") >= threshold).drop("score").toDF(*names)
