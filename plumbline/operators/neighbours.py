"""Exact nearest neighbours and synthetic minority rows.

Every point belongs to the cell of its nearest pivot, one of a drawn sample of points. Its k-th neighbour
inside a block of its own cell bounds how far the true ones can lie; only cells that the
triangle inequality lets come that close to it are asked: by the range of their members' distances
from their pivot, and by the plane between the two pivots. Crowded cells are split into blocks by a hash of
the key, so a block has a bounded number of rows, however many points there are and however they lie.
Points travel with the bound, and inside a block a matrix product leaves the few rows that can meet it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.durability import durable
from plumbline.functions.expressions import (
    col,
    draw,
    draw_number,
    DRAWS,
    numeric_columns,
)
from plumbline.operators.ordering import rank_by_draw
from plumbline.operators.sampling import _two_classes

CELL_ROWS = 1024
# In many dimensions hardly a cell can be left out, so that points go to most cells; then cells hold more rows.
MANY_DIMENSIONS = 16
LARGE_CELL_ROWS = 8192
# Pivots go to every task. Beyond so many, cells grow, but not their blocks.
MOST_PIVOTS = 2048
_PROBES_PER_CELL_ROW = 16
_SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _blocks(rows: int, width: int, dims: int) -> list[slice]:
    """Row slices whose distance blocks stay near 32 MB."""
    step = max(1, 4_000_000 // max(1, width * dims))
    return [slice(i, i + step) for i in range(0, rows, step)]


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and per row of ``a`` how far off they and exact ones may be."""
    own, other = (a**2).sum(axis=1), (b**2).sum(axis=1)
    off = 1e-15 * (16 + 4 * a.shape[1]) * (own + other.max(initial=0.0))
    return own[:, None] + other[None, :] - 2 * (a @ b.T), off


def _kth(squares: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest value of each row, infinite where there are fewer."""
    if squares.shape[1] < k:
        return np.full(len(squares), np.inf)
    kth = np.partition(squares, k - 1, axis=1)[:, k - 1]
    return np.where(np.isnan(kth), np.inf, kth)


def _pair_distances(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.empty(len(at))
    for rows in _blocks(len(at), 1, a.shape[1]):
        out[rows] = np.sqrt(((a[at[rows]] - b[to[rows]]) ** 2).sum(axis=1))
    return out


def _nearest(probes: pd.DataFrame, cell: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest cell rows within every probe's radius, ties by id, a row never its own neighbour.

    A matrix product finds the few rows that can be among them; only their distances are
    computed one by one.
    """
    order = cell["id"].argsort(kind="stable").to_numpy()
    ids = cell["id"].to_numpy()[order]
    points = np.stack(cell["x"].to_numpy())[order]
    asked = probes["id"].to_numpy()
    where = np.stack(probes["x"].to_numpy())
    radius = probes["radius"].to_numpy()
    found: list[pd.DataFrame] = []
    for rows in _blocks(len(asked), len(ids), 1):
        with np.errstate(over="ignore", invalid="ignore"):
            squares, off = _squares(where[rows], points)
            squares[asked[rows][:, None] == ids[None, :]] = np.inf
            limit = (radius[rows] * (1 + _SLACK)) ** 2 + off
            near = squares <= limit[:, None]
            # Beyond k within the radius, those that are farther than the k-th by more than both can be off.
            many = np.flatnonzero(near.sum(axis=1) > k)
            if len(many):
                near[many] &= squares[many] <= (_kth(squares[many], k) + 2 * off[many])[:, None]
            # Squares beyond what numbers hold say nothing.
            near |= np.isnan(squares) | ~np.isfinite(off)[:, None]
        near &= asked[rows][:, None] != ids[None, :]
        at, to = np.nonzero(near)
        gaps = _pair_distances(where[rows], at, points, to)
        best = np.lexsort((to, gaps, at))
        at, to, gaps = at[best], to[best], gaps[best]
        first = np.searchsorted(at, at, side="left")
        own = (np.arange(len(at)) - first < k) & np.isfinite(gaps)
        found.append(pd.DataFrame({"id": asked[rows][at[own]], "neighbour": ids[to[own]], "distance": gaps[own]}))
    return pd.concat(found, ignore_index=True)


def _lower_bounds(
    x: np.ndarray, own: np.ndarray, pivots: np.ndarray, ranges: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """How close each cell can come to each point, and how exact that is known."""
    to = _distances(x, pivots)
    mine = to[np.arange(len(x)), own][:, None]
    apart = _distances(pivots, pivots)[own]
    ball = np.maximum(to - ranges[:, 1], ranges[:, 0] - to)
    with np.errstate(divide="ignore", invalid="ignore"):
        # Members of a cell lie on its pivot's side of the plane between the two.
        plane = np.where(apart > 0, (to**2 - mine**2) / (2 * apart), -np.inf)
        exact = np.where(apart > 0, (to**2 + mine**2) / apart, 0.0)
    return np.maximum(ball, plane), _SLACK * (to + mine + exact)


def nearest_neighbours(
    df: DataFrame, key: str, features: Sequence[str] | str, k: int = 5, cell_rows: int | None = None
) -> DataFrame:
    """``(key, place, neighbour, distance)`` of the k nearest other rows, ties by key.

    ``features`` are numeric columns or one array column. ``key`` must identify rows. Rows with a
    coordinate that is null, NaN or infinite are left out.
    """
    vector = (
        col(features).cast("array<double>")
        if isinstance(features, str)
        else F.array(*[col(f).cast("double") for f in features])
    )
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    points = df.select(col(key).alias("id"), vector.alias("x")).where(finite)
    id_type = df.schema[key].dataType.simpleString()
    near_schema = f"id {id_type}, neighbour {id_type}, distance double"
    if cell_rows is None:
        one = points.select(F.size("x").alias("n")).first()
        cell_rows = LARGE_CELL_ROWS if one is not None and one["n"] >= MANY_DIMENSIONS else CELL_ROWS
    wanted = min(MOST_PIVOTS, math.ceil(points.count() / cell_rows))
    drawn = points.select("x", draw(0, "id").alias("drawn")).orderBy("drawn").limit(wanted).collect()
    if not drawn:
        return df.sparkSession.createDataFrame([], near_schema).select(
            F.col("id").alias(key), F.lit(0).alias("place"), "neighbour", "distance"
        )
    pivots = np.unique(np.array([r["x"] for r in drawn], dtype=float), axis=0)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _blocks(len(batch), len(pivots), pivots.shape[1]):
                own = batch.iloc[rows]
                to = _distances(np.stack(own["x"].to_numpy()), pivots)
                cell = to.argmin(axis=1)
                yield own.assign(cell=cell, d=to[np.arange(len(own)), cell])

    # Both tables below are read several times.
    placed = durable(points.mapInPandas(place, f"id {id_type}, x array<double>, cell long, d double"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    # An empty cell is infinitely far away.
    ranges = np.full((len(pivots), 2), [np.inf, -np.inf])
    blocks = np.zeros(len(pivots), np.int64)
    for r in sizes.collect():
        ranges[r["cell"]] = r["low"], r["high"]
        blocks[r["cell"]] = -(-r["n"] // cell_rows)
    salts = df.sparkSession.createDataFrame(
        [(i, int(n)) for i, n in enumerate(blocks) if n], "cell long, salts long"
    )
    located = placed.join(F.broadcast(salts), "cell").select(
        "id", "x", "cell", F.pmod(F.xxhash64("id"), "salts").alias("salt")
    )

    def own_radius(cell: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(cell["x"].to_numpy())
        radius = np.full(len(cell), np.inf)
        if len(cell) > k:
            for part in _blocks(len(cell), len(cell), 1):
                # The row itself is at distance 0 and takes the first place.
                with np.errstate(over="ignore", invalid="ignore"):
                    squares, off = _squares(points[part], points)
                    reach = np.sqrt(np.maximum(_kth(squares, k + 1) + off, 0.0))
                radius[part] = np.where(np.isfinite(reach), reach, np.inf)
        return cell[["id", "x", "cell"]].assign(radius=radius)

    bounded = durable(
        located.groupBy("cell", "salt").applyInPandas(
            own_radius, f"id {id_type}, x array<double>, cell long, radius double"
        )
    )

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _blocks(len(batch), len(pivots), pivots.shape[1]):
                own = batch.iloc[rows]
                x, cell = np.stack(own["x"].to_numpy()), own["cell"].to_numpy()
                low, exact = _lower_bounds(x, cell, pivots, ranges)
                reach = own["radius"].to_numpy()[:, None] * (1 + _SLACK) + exact
                at, to = np.nonzero((low <= reach) & (blocks > 0))
                # Each block of a cell is asked by itself.
                times = blocks[to]
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, to = np.repeat(at, times), np.repeat(to, times)
                yield pd.DataFrame(
                    {
                        "id": own["id"].to_numpy()[at],
                        "x": own["x"].to_numpy()[at],
                        "radius": own["radius"].to_numpy()[at],
                        "cell": to,
                        "salt": salt,
                    }
                )

    probes = bounded.mapInPandas(aim, f"id {id_type}, x array<double>, radius double, cell long, salt long")
    limit = min(cell_rows, CELL_ROWS) * _PROBES_PER_CELL_ROW
    parts = probes.groupBy("cell", "salt").agg(
        F.ceil(F.count("*") / limit).alias("parts")
    )
    asked = probes.join(parts, ["cell", "salt"]).withColumn(
        "part", F.pmod(F.xxhash64("id", F.lit("part")), "parts")
    )
    offered = located.join(parts, ["cell", "salt"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    )
    group = ["cell", "salt", "part"]

    def match(probe: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        if probe.empty or cell.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        return _nearest(probe, cell, k)

    near = (
        asked.select(*group, "id", "x", "radius")
        .groupBy(*group)
        .cogroup(offered.select(*group, "id", "x").groupBy(*group))
        .applyInPandas(match, near_schema)
    )
    best = W.partitionBy("id").orderBy("distance", "neighbour")
    return (
        near.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= k)
        .select(F.col("id").alias(key), "place", "neighbour", "distance")
    )


def smote(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    features: Sequence[str] | None = None,
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """All rows plus synthetic minority rows up to the size of the larger class.

    A synthetic row lies at a random place between a minority row and one of its ``k`` nearest
    minority neighbours. Its key and other columns are null; features become double.
    """
    minor, m, _, n = _two_classes(df, target)
    if m <= k:
        raise ValueError(f"SMOTE needs more than {k} minority rows, found {m}")
    names = list(features or [c for c in numeric_columns(df) if c not in (*key, target)])
    whole = df.where(col(target).isNotNull()).withColumns(
        {c: col(c).cast("double") for c in names}
    )
    if m == n:
        return whole
    small = whole.where(col(target) == F.lit(minor)).select(
        F.concat_ws("|", *key).alias("_id") if len(key) > 1 else col(key[0]).alias("_id"),
        draw(seed, *key).alias("_draw"),
        F.array(*[col(c) for c in names]).alias("_x"),
    )
    ranked = rank_by_draw(small, [], "_draw", ["_id"], "_rank").select(
        "_id", "_x", (F.col("_rank") - 1).alias("_rank")
    )
    near = nearest_neighbours(small, "_id", "_x", k)
    other = small.select(F.col("_id").alias("neighbour"), F.col("_x").alias("_y"))
    pairs = near.join(ranked, "_id").join(other, "neighbour").select(
        "_rank", "place", "_x", "_y"
    )

    def number(name: str):
        return draw_number(draw(seed, F.lit(name), F.col("id")))

    picks = df.sparkSession.range(n - m).select(
        (number("base") % F.lit(m)).alias("_rank"),
        (number("neighbour") % F.lit(k) + 1).cast("int").alias("place"),
        (number("place") / F.lit(float(DRAWS))).alias("_u"),
    )
    made = picks.join(pairs, ["_rank", "place"]).select(
        F.lit(minor).cast(df.schema[target].dataType).alias(target),
        *[
            (F.col("_x")[i] + F.col("_u") * (F.col("_y")[i] - F.col("_x")[i])).alias(c)
            for i, c in enumerate(names)
        ],
    )
    return whole.unionByName(made, allowMissingColumns=True)
