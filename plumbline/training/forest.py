"""Random forests over distinct feature vectors: rows with equal features take the same way through a tree.

A tree needs of such rows only how many each class has, so a forest's work follows the distinct vectors and
not the rows. The bootstrap stays one of rows: a sum of n Poisson draws of mean 1 is one Poisson draw of
mean n. Splits, stops and pruning are those of MLlib's forests.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Distinct vectors, and their numbers in all, that one task holds. Beyond them MLlib grows the forest.
CELLS = 50_000
CELL_VALUES = 2_000_000
# Trees of one task, and what it handles at a time: vectors of all trees, nodes of a level.
TREES_PER_TASK = 10
POINTS = 100_000
NODES = 4_000


def cell_table(train: DataFrame, score: DataFrame) -> DataFrame:
    """``(features, zeros, ones, others)``: rows by class among ``train`` by vector; none for ``score`` alone.

    ``train`` holds ``(features, label, n)``.
    """
    none = F.lit(None).cast("double").alias("label")
    rows = train.select("features", "label", "n").unionByName(
        score.select("features").distinct().select("features", none, F.lit(0).cast("long").alias("n"))
    )

    def of(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    zero, one = F.col("label").eqNullSafe(F.lit(0.0)), F.col("label").eqNullSafe(F.lit(1.0))
    return rows.groupBy("features").agg(
        of(zero).alias("zeros"), of(one).alias("ones"), of(~zero & ~one).alias("others")
    )


def fits_tasks(cells: DataFrame) -> bool:
    """Whether a task can hold the table of cells, and all labels are 0 and 1."""
    found = cells.agg(
        F.count("*").alias("n"), F.max(F.unwrap_udt("features")["size"]).alias("sparse"),
        F.max(F.size(F.unwrap_udt("features")["values"])).alias("dense"), F.sum("others").alias("others"),
    ).first()
    return not found["others"] and found["n"] <= min(CELLS, CELL_VALUES // max(1, found["sparse"] or 0, found["dense"] or 0))


def forest_scores(
    cells: DataFrame, weights: Sequence[float], settings: Mapping[str, Any], seed: int
) -> DataFrame:
    """``(features, y_score)``: the forest's probability of class 1 for every cell.

    ``weights`` are those of the classes 0 and 1. Trees are dealt to tasks; what a tree draws depends on
    its number and the cells only.
    """
    trees = settings["trees"]
    tasks = -(-trees // TREES_PER_TASK)
    dealt = (
        cells.select(vector_to_array("features").alias("x"), "zeros", "ones")
        .crossJoin(F.broadcast(cells.sparkSession.range(tasks).withColumnRenamed("id", "task")))
        .repartition(tasks, "task")
    )

    def grow(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), -1)
        order = np.lexsort(x.T[::-1])
        x, n = x[order], rows[["zeros", "ones"]].to_numpy(np.int64)[order]
        numbers = range(key[0] * TREES_PER_TASK, min(trees, (key[0] + 1) * TREES_PER_TASK))
        score, votes = grown(x, n, weights, numbers, settings, seed)
        return pd.DataFrame({"x": rows["x"].to_numpy()[order], "part": [[key[0], s, v] for s, v in zip(score, votes)]})

    parts = dealt.groupBy("task").applyInPandas(grow, "x array<double>, part array<double>")
    # Added in the order of the tasks, so that sums are the same in every run.
    scores = parts.groupBy("x").agg(F.array_sort(F.collect_list("part")).alias("parts"))

    def total(at: int) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda s, p: s + p[at])

    wide = cells.select("features", vector_to_array("features").alias("x"))
    return wide.join(scores, "x").select(
        "features", F.when(total(2) > 0, total(1) / total(2)).otherwise(0.5).alias("y_score")
    )


def thresholds(values: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature may be split: between all its values, or at ``bins - 1`` places of about equal weight."""
    found, at = np.unique(values, return_inverse=True)
    middle = (found[1:] + found[:-1]) / 2
    if len(middle) < bins:
        return middle
    reached = np.cumsum(np.bincount(at, weight))
    stride = reached[-1] / bins
    chosen, target = [], stride
    for i in range(1, len(found)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            chosen.append(middle[i - 1])
            target += stride
    return np.array(chosen)


def grown(
    x: np.ndarray, n: np.ndarray, weights: Sequence[float], numbers: Sequence[int],
    settings: Mapping[str, Any], seed: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the leaves' shares of class 1 over the trees, and the trees that have any rows, by cell."""
    used = n.sum(axis=1) > 0
    mass = (n * np.asarray(weights)).sum(axis=1)
    binned = np.empty(x.shape, dtype=np.int16)
    for f in range(x.shape[1]):
        binned[:, f] = np.searchsorted(thresholds(x[used, f], mass[used], settings["max_bins"]), x[:, f])
    score, votes = np.zeros(len(x)), np.zeros(len(x))
    some = max(1, POINTS // len(x))
    for at in range(0, len(numbers), some):
        for share in _trees(binned, n, weights, numbers[at : at + some], settings, seed):
            known = ~np.isnan(share)
            score[known] += share[known]
            votes += known
    return score, votes


def _trees(binned, n, weights, numbers, settings, seed) -> Iterator[np.ndarray]:
    """Each tree's share of class 1 by cell; trees grow together, level by level."""
    size, width = binned.shape
    most = int(np.ceil(np.sqrt(width))) if settings["trees"] > 1 else width
    rngs = [np.random.default_rng([seed, t]) for t in numbers]
    drawn = np.concatenate([r.poisson(n) for r in rngs]).astype(float)
    w0, w1, rows = drawn[:, 0] * weights[0], drawn[:, 1] * weights[1], drawn.sum(axis=1)
    cell = np.tile(np.arange(size), len(numbers))
    node = np.repeat(np.arange(len(numbers)), size)
    tree = np.arange(len(numbers))  # by node, as are the next
    stats = _stats(node, 0, len(numbers), w0, w1, rows)
    left = np.full(len(numbers), -1)
    levels, start = [], 0
    for _ in range(settings["max_depth"]):
        s = stats[start:]
        open_ = start + np.flatnonzero((s[:, 0] > 0) & (s[:, 1] > 0) & (s[:, 2] >= 2 * settings["min_leaf"]))
        if not len(open_):
            break
        draws = np.concatenate([rngs[t].random((c, width)) for t, c in enumerate(np.bincount(tree[open_])) if c])
        tried = np.argsort(draws, axis=1)[:, :most]
        place = np.full(len(stats), -1)
        place[open_] = np.arange(len(open_))
        mine = place[node]
        points = np.flatnonzero(mine >= 0)
        feature, cut = np.full(len(open_), -1), np.zeros(len(open_), dtype=int)
        for a in range(0, len(open_), NODES):
            b = min(a + NODES, len(open_))
            own = points[(mine[points] >= a) & (mine[points] < b)]
            feature[a:b], cut[a:b] = _best(
                binned, cell[own], mine[own] - a, tried[a:b], stats[open_[a:b]], w0[own], w1[own], rows[own],
                settings["min_leaf"],
            )
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        parents, start = open_[split], len(stats)
        left[parents] = start + 2 * np.arange(len(split))
        points = points[feature[mine[points]] >= 0]
        at = mine[points]
        node[points] = left[node[points]] + (binned[cell[points], feature[at]] > cut[at])
        end = start + 2 * len(split)
        stats = np.concatenate([stats, _stats(node[points], start, end, w0[points], w1[points], rows[points])])
        tree = np.concatenate([tree, np.repeat(tree[parents], 2)])
        left = np.concatenate([left, np.full(end - start, -1)])
        levels.append(parents)
    # Leaves of one parent that predict the same become one, from the lowest level up.
    one = stats[:, 1] > stats[:, 0]
    leaf = left < 0
    for parents in reversed(levels):
        a, b = left[parents], left[parents] + 1
        leaf[parents] = leaf[a] & leaf[b] & (one[a] == one[b])
    final = np.arange(len(stats))
    for parents in levels:
        merged = leaf[parents] | (final[parents] != parents)
        for child in (left[parents], left[parents] + 1):
            final[child] = np.where(merged, final[parents], child)
    both = stats[:, 0] + stats[:, 1]
    share = np.divide(stats[:, 1], both, out=np.full(len(both), np.nan), where=both > 0)
    yield from share[final[node]].reshape(len(numbers), size)


def _stats(node, start, end, w0, w1, rows) -> np.ndarray:
    """Weights of both classes and rows of the nodes from ``start`` to ``end``."""
    return np.stack([np.bincount(node - start, v, end - start) for v in (w0, w1, rows)], axis=1)


def _impurity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.maximum(a + b, 1e-300)
    return 2 * (a / both) * (b / both)


def _best(binned, cell, place, tried, stats, w0, w1, rows, least) -> tuple[np.ndarray, np.ndarray]:
    """Feature and last bin of the left side that lower the Gini impurity most, by node; -1 if none does."""
    nodes, bins = len(stats), int(binned.max()) + 1
    gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, dtype=int)
    if bins < 2:
        return feature, cut
    a, b, all_ = stats[:, :1], stats[:, 1:2], stats[:, 2:]
    whole = _impurity(a, b)
    for slot in range(tried.shape[1]):
        key = place * bins + binned[cell, tried[place, slot]]
        la, lb, ln = (
            np.cumsum(np.bincount(key, v, nodes * bins).reshape(nodes, bins), axis=1)[:, :-1] for v in (w0, w1, rows)
        )
        ra, rb = np.maximum(a - la, 0), np.maximum(b - lb, 0)
        share = (la + lb) / (a + b)
        gained = whole - share * _impurity(la, lb) - (1 - share) * _impurity(ra, rb)
        gained[(ln < least) | (all_ - ln < least)] = -1
        at = gained.argmax(axis=1)
        found = gained[np.arange(nodes), at]
        better = found > gain
        gain[better], feature[better], cut[better] = found[better], tried[better, slot], at[better]
    return feature, cut
