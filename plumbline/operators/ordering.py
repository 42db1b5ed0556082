"""Exact ranks, exact quantiles and running totals that no single task has to sort.

Every helper first counts rows per bucket of an order-preserving key, which combines on the
map side and leaves a small table, and then works inside buckets only. Hot groups are thereby
split, while the outcome equals that of one global sort. A bucket with more than ``FEW`` rows is cut
anew between its own least and largest value, until buckets hold few rows or one value, so values that
crowd in a narrow range end up in many buckets too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from dataclasses import field as dataclass_field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.durability import durable
from plumbline.functions.expressions import FLOATING_TYPES, col, magnitude_bucket

# Most rows a lookup table may have to be broadcast by hint.
BROADCAST_ROWS = 100_000
# Most rows of a bucket with several values that one task may sort, and parts to cut a larger one into.
FEW = 200_000
PARTS = 4096
# Most value ranges to spell out in a filter.
PUSHED_RANGES = 64


def bucket_digits(spark: SparkSession) -> int:
    """Hex digits of a draw used as bucket: about 64 buckets per shuffle partition."""
    wanted = 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    digits = 2
    while 16**digits < wanted and digits < 6:
        digits += 1
    return digits


def match_null_safe(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join that treats null keys as equal and keeps the key columns once."""
    renamed = right.select(
        *[col(c).alias(f"__r_{c}") if c in on else col(c) for c in right.columns]
    )
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"__r_{c}"])
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in on])


def _earlier(by: Sequence[str], order: Column) -> W:
    return W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _solid_keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add key columns without nulls that group the way ``by`` does, and name them.

    Plain equality on them lets one shuffle serve both a join and the window after it, which a
    null-safe comparison would not.
    """
    added: dict[str, Column] = {}
    names: list[str] = []
    for i, c in enumerate(by):
        field = df.schema[c]
        if not field.nullable:
            names.append(c)
            continue
        if isinstance(field.dataType, T.StringType):
            stand_in = F.lit("")
        elif isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            stand_in = F.lit(0).cast(field.dataType)
        else:
            stand_in = F.lit("1970-01-01").cast(field.dataType)
        added[f"_null{i}"] = col(c).isNull()
        added[f"_key{i}"] = F.coalesce(col(c), stand_in)
        names += [f"_null{i}", f"_key{i}"]
    return (df.withColumns(added) if added else df), names


def rank_by_draw(
    df: DataFrame, by: Sequence[str], drawn: str, tie_break: Sequence[str], rank: str = "rank"
) -> DataFrame:
    """Add the 1-based rank of every row within ``by``, in order of its draw."""
    keyed, keys = _solid_keys(df, by)
    slot = F.coalesce(F.substring(drawn, 1, bucket_digits(df.sparkSession)), F.lit(""))
    rows = keyed.withColumn("_slot", slot)
    sizes = rows.groupBy(*keys, "_slot").agg(F.count("*").alias("_size"))
    offsets = sizes.select(
        *keys,
        "_slot",
        F.coalesce(F.sum("_size").over(_earlier(keys, F.col("_slot"))), F.lit(0)).alias("_before"),
    )
    inside = W.partitionBy(*keys, "_slot").orderBy(drawn, *tie_break)
    return (
        rows.join(offsets, [*keys, "_slot"])
        .withColumn(rank, F.row_number().over(inside) + F.col("_before"))
        .select(*df.columns, rank)
    )


def draw_cuts(
    df: DataFrame, draws: Mapping[str, Column], wanted: Mapping[str, int]
) -> dict[str, str]:
    """For every name, the draw up to which exactly ``wanted[name]`` rows lie.

    A null draw takes a row out of that name's contest. Runs two scans of the columns the draws
    need and returns one short text per name, so that taking the sample afterwards is a plain
    row filter without a shuffle.
    """
    active = {n: k for n, k in wanted.items() if k > 0}
    if not active:
        return {}
    digits = bucket_digits(df.sparkSession)
    entries = F.array(
        *[F.struct(F.lit(n).alias("name"), draws[n].alias("drawn")) for n in active]
    )
    rows = (
        df.select(F.inline(entries))
        .where(F.col("drawn").isNotNull())
        .withColumn("slot", F.substring("drawn", 1, digits))
    )
    need = F.create_map(*[F.lit(x) for pair in active.items() for x in pair])
    sizes = rows.groupBy("name", "slot").agg(F.count("*").alias("size"))
    edges = (
        sizes.withColumn(
            "before",
            F.coalesce(F.sum("size").over(_earlier(["name"], F.col("slot"))), F.lit(0)),
        )
        .withColumn("place", need[F.col("name")] - F.col("before"))
        .where((F.col("place") > 0) & (F.col("place") <= F.col("size")))
        .select("name", "slot", "place")
        .collect()
    )
    found = {e["name"] for e in edges}
    short = sorted(set(active) - found)
    if short:
        raise ValueError(f"Fewer rows than requested for: {', '.join(short)}")
    in_edge = F.lit(False)
    for e in edges:
        in_edge = in_edge | ((F.col("name") == e["name"]) & (F.col("slot") == e["slot"]))
    place = F.create_map(*[F.lit(x) for e in edges for x in (e["name"], e["place"])])
    tied = rows.where(in_edge).groupBy("name", "drawn").agg(F.count("*").alias("copies"))
    order = W.partitionBy("name").orderBy("drawn")
    cuts = (
        tied.withColumn("reach", F.sum("copies").over(order))
        .where(
            (F.col("reach") >= place[F.col("name")])
            & (F.col("reach") - F.col("copies") < place[F.col("name")])
        )
        .select("name", "drawn", (F.col("reach") - place[F.col("name")]).alias("excess"))
        .collect()
    )
    if any(c["excess"] for c in cuts):
        raise ValueError("The key does not identify rows: several rows share the draw at the cut")
    return {c["name"]: c["drawn"] for c in cuts}


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    totals: Sequence[str],
    bucket: Callable[[Column], Column] = magnitude_bucket,
    descending: bool = False,
) -> DataFrame:
    """Add ``<total>_before``: the sum over the rows of the group that come earlier.

    Expects one row per group and ``order`` value; ``bucket`` must never decrease with it. A look
    at the bucket sizes, which are kept, comes first; crowded buckets are cut at the values found
    in them, each round by one more key.
    """
    keyed, keys = _solid_keys(df, by)
    # A bucket is null only for NaN, which sorts above every number.
    rows = keyed.withColumn("_bucket", F.coalesce(bucket(col(order)), F.lit(2**62)))
    path = ["_bucket"]

    def sort(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    while True:
        sums = durable(
            rows.groupBy(*keys, *path).agg(
                *[F.sum(t).alias(f"_sum_{t}") for t in totals],
                F.count("*").alias("_n"),
                F.min(col(order)).alias("_low"),
                F.max(col(order)).alias("_high"),
            )
        )
        edges = sums.where((F.col("_n") > FEW) & (F.col("_low") < F.col("_high"))).select(
            *keys, *path, "_n", "_low", "_high"
        )
        crowded = edges.limit(BROADCAST_ROWS + 1).count()
        if not crowded:
            break
        at = len(path)
        # Some FEW / 16 rows a part if values lie evenly; other parts are cut again.
        parts = F.ceil(F.col("_n") * 16 / F.lit(FEW)) + 1
        cut = F.least(parts - 1, F.floor(_between(col(order), "_low", "_high", df.schema[order]) * parts))
        joined = rows.join(F.broadcast(edges) if crowded <= BROADCAST_ROWS else edges, [*keys, *path], "left")
        rows = joined.withColumn(f"_part{at}", F.coalesce(cut.cast("long"), F.lit(0))).drop("_n", "_low", "_high")
        path.append(f"_part{at}")
    outer = W.partitionBy(*keys).orderBy(*map(sort, path)).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        *path,
        *[F.coalesce(F.sum(f"_sum_{t}").over(outer), F.lit(0)).alias(f"_off_{t}") for t in totals],
    )
    inner = _earlier([*keys, *path], sort(order))
    return rows.join(offsets, [*keys, *path]).select(
        *df.columns,
        *[
            (F.col(f"_off_{t}") + F.coalesce(F.sum(t).over(inner), F.lit(0))).alias(f"{t}_before")
            for t in totals
        ],
    )


def _between(value: Column, low: str, high: str, field: T.StructField) -> Column:
    """Where a number lies between two columns, from 0 to 1; never decreases with it."""
    a, b = F.col(low), F.col(high)
    if isinstance(field.dataType, T.IntegralType):
        # Whole numbers beyond 2^53 differ although their doubles don't.
        value, a, b = (x.cast("decimal(20,0)") for x in (value, a, b))
    share = (value - a).cast("double") / F.nullif((b - a).cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def _text_number(value: Column, skip: int) -> Column:
    """The six bytes after the first ``skip`` ones as a number; never decreases among equal starts."""
    digits = F.rpad(F.hex(F.substring(value.cast("binary"), skip + 1, 6)), 12, "0")
    return F.conv(digits, 16, 10).cast("double")


def _common_start(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def value_at(distinct: DataFrame, column: str, place: int) -> object:
    """The value at a 0-based place in ascending order, of a column of distinct values.

    Numbers, dates, timestamps and text. The range of values is cut into parts, which are counted;
    the part with the place becomes the range, until it holds few values. Only counts of parts come to
    the driver.
    """
    kind, value = distinct.schema[column].dataType, col(column)
    ends = distinct.agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).first()
    n, low, high = ends["n"], ends["low"], ends["high"]
    if not 0 <= place < n:
        raise ValueError("The place lies outside the values")
    rows = distinct.select(value.alias("value"))
    if isinstance(kind, FLOATING_TYPES) and math.isnan(high):
        # NaN is the greatest value.
        if place == n - 1:
            return high
        rows = rows.where(~F.isnan("value"))
        n, high = n - 1, rows.agg(F.max("value")).first()[0]
    while n > FEW and low != high:
        if isinstance(kind, T.StringType):
            skip = _common_start(low, high)
            a, b = (_text_number(F.lit(x), skip) for x in (low, high))
            share = (_text_number(F.col("value"), skip) - a) / F.nullif(b - a, F.lit(0.0))
        else:
            share = _share_of(kind, low, high)
        part = F.coalesce(F.least(F.lit(PARTS - 1), F.floor(share * PARTS)), F.lit(0))
        parts = (
            rows.groupBy(part.alias("part"))
            .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            .orderBy("part")
            .collect()
        )
        for p in parts:
            if place < p["n"]:
                break
            place -= p["n"]
        if p["n"] == n:
            break
        n, low, high = p["n"], p["low"], p["high"]
        rows = rows.where(F.col("value").between(F.lit(low), F.lit(high)))
    order = W.orderBy("value")
    return rows.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") == place).first()["value"]


def _share_of(kind: T.DataType, low: object, high: object) -> Column:
    """Where ``value`` lies between two literals of its type, from 0 to 1."""

    def number(x: Column) -> Column:
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(x).cast("decimal(20,0)")
        if isinstance(kind, T.TimestampNTZType):
            day = F.unix_date(x.cast("date")).cast("decimal(20,0)")
            clock = (F.hour(x) * 60 + F.minute(x)) * 60 + F.extract(F.lit("SECONDS"), x)
            return day * 86_400_000_000 + (clock * 1_000_000).cast("decimal(20,0)")
        if isinstance(kind, T.DateType):
            return F.unix_date(x).cast("decimal(20,0)")
        if isinstance(kind, T.IntegralType):
            return x.cast("decimal(20,0)")
        return magnitude_bucket(x) if endless else x.cast("double")

    endless = isinstance(kind, FLOATING_TYPES) and math.isinf(high - low)
    a, b = (number(F.lit(x).cast(kind)) for x in (low, high))
    return (number(F.col("value")) - a).cast("double") / F.nullif((b - a).cast("double"), F.lit(0.0))


def quantile_targets(
    histogram: DataFrame,
    keys: Sequence[str],
    probabilities: Sequence[float],
    carry: Sequence[str] = (),
) -> DataFrame:
    """Where the wanted positions lie in a histogram of ``_bucket, _count, _low, _high``.

    Per key and probability the low and the high position, each with its bucket and its place
    inside the bucket. Rows without a bucket pass through. ``carry`` columns are kept.
    """
    ordered = F.when(F.col("_bucket").isNotNull(), F.col("_count"))
    position = F.col("probability") * (F.col("_total") - 1)
    return (
        histogram.withColumns(
            {
                "_before": F.coalesce(
                    F.sum(ordered).over(_earlier(keys, F.col("_bucket"))), F.lit(0)
                ),
                "_total": F.sum(ordered).over(W.partitionBy(*keys)),
            }
        )
        # Exploded in a step of its own: window frames above must not see the copies.
        .withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("_share", position - F.floor(position))
        .withColumn("_end", F.explode(F.array(F.lit("low"), F.lit("high"))))
        .withColumn(
            "_place",
            F.when(F.col("_end") == "low", F.floor(position)).otherwise(F.ceil(position))
            - F.col("_before"),
        )
        .where(
            F.col("_bucket").isNull()
            | ((F.col("_place") >= 0) & (F.col("_place") < F.col("_count")))
        )
        .select(
            *keys, "_bucket", "probability", "_share", "_end", "_place", "_low", "_high", "_count", *carry
        )
    )


def _recut(rows: DataFrame, edges: DataFrame, stable: Sequence[str]) -> DataFrame:
    """Rows of crowded buckets, under the number of their part."""
    value, a, b = F.col("_value"), F.col("_cut_low"), F.col("_cut_high")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - a) / (b - a)))
    part = F.least(F.lit(PARTS - 1), F.floor(share * PARTS))
    return (
        match_null_safe(rows, F.broadcast(edges), [*stable, "_bucket"])
        .withColumn("_bucket", F.col("_cut") * PARTS + part)
        .drop("_cut", "_cut_low", "_cut_high")
    )


@dataclass
class _Level:
    """Open positions of one round of cuts: ``few`` are in buckets to sort, ``crowded`` are not."""

    few: list[Row]
    crowded: list[Row]
    stable: Sequence[str]
    before: _Level | None = None
    found: list[Row] = dataclass_field(default_factory=list)

    def _cuts(self) -> dict[tuple, tuple[int, float, float]]:
        """Number and ends of each crowded bucket, whichever groups find a position in it."""
        ends: dict[tuple, tuple[float, float]] = {}
        for r in self.crowded:
            k = (*[r[c] for c in self.stable], r["_bucket"])
            low, high = ends.get(k, (r["_low"], r["_high"]))
            ends[k] = (min(low, r["_low"]), max(high, r["_high"]))
        return {k: (i, *e) for i, (k, e) in enumerate(ends.items())}

    def edges(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        fields = [schema[c] for c in (*self.stable, "_bucket")]
        fields += [T.StructField("_cut", T.LongType()), T.StructField("_cut_low", T.DoubleType())]
        cuts = [(*k, *cut) for k, cut in self._cuts().items()]
        return spark.createDataFrame(cuts, T.StructType([*fields, T.StructField("_cut_high", T.DoubleType())]))

    def rows(self, bucketed: DataFrame) -> DataFrame:
        """Rows of the table under the buckets of this round."""
        chain: list[_Level] = []
        level = self.before
        while level is not None:
            chain.append(level)
            level = level.before
        for level in reversed(chain):
            bucketed = _recut(bucketed, level.edges(bucketed.sparkSession, level.schema), level.stable)
        return bucketed

    def narrowed(self, histogram: DataFrame, keys: Sequence[str], schema: T.StructType) -> DataFrame:
        """Targets inside the parts, from the histogram of the parts."""
        self.schema = schema
        cut = self._cuts()
        numbers = [(cut[(*[r[c] for c in self.stable], r["_bucket"])][0], r) for r in self.crowded]
        own = [*keys, "probability", "_share", "_end", "_place"]
        fields = [T.StructField("_cut", T.LongType()), *[schema[c] for c in own]]
        wanted = histogram.sparkSession.createDataFrame(
            [(i, *[r[c] for c in own]) for i, r in numbers], T.StructType(fields)
        )
        cumulated = histogram.withColumn("_cut", F.floor(F.col("_bucket") / PARTS)).withColumn(
            "_before", F.coalesce(F.sum("_count").over(_earlier([*keys, "_cut"], F.col("_bucket"))), F.lit(0))
        )
        inside = F.col("_place") - F.col("_before")
        return (
            match_null_safe(cumulated, F.broadcast(wanted), [*keys, "_cut"])
            .where((inside >= 0) & (inside < F.col("_count")))
            .withColumn("_place", inside)
            .select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        )


def _levels(known: Sequence[Row], stable: Sequence[str]) -> Iterator[_Level]:
    """Rounds of cuts until no position lies in a crowded bucket.

    The ends of a bucket fall into different parts, so every round narrows what is left.
    """
    before = None
    while True:
        open_ends = [r for r in known if r["_low"] != r["_high"]]
        if not open_ends:
            return
        crowded = [r for r in open_ends if r["_count"] > FEW]
        level = _Level([r for r in open_ends if r["_count"] <= FEW], crowded, stable, before)
        yield level
        if not crowded:
            return
        known, before = level.found, level


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    regroup: Callable[[DataFrame], DataFrame] | None = None,
    stable: Sequence[str] | None = None,
    found: Sequence[Row] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles: ``(column, *by, probability, quantile)``.

    One scan builds a histogram of fine buckets, which shows the bucket of every wanted position.
    A bucket with one distinct value settles its position; for the others a second scan reads
    just the columns concerned and sorts just the rows of those buckets. A crowded bucket is cut
    into parts between its ends by a further scan first, and its crowded parts again. Null and NaN
    are left out. ``regroup`` may map counted rows to other groups, such as folds to the training sets
    they belong to; ``stable`` then names the ``by`` columns it leaves alone. ``found`` are rows of
    ``quantile_targets`` if the histogram was made elsewhere. Beyond ``BROADCAST_ROWS`` positions,
    groups are many and buckets are not cut again.
    """
    names = list(columns)
    keys = ["column", *by]
    stable = ["column", *(by if stable is None else stable)]

    def number(c: str) -> Column:
        return col(c) if isinstance(df.schema[c].dataType, T.DoubleType) else col(c).cast("double")

    def bucketed(chosen: Sequence[str], within: Column | None = None) -> DataFrame:
        numbers = F.array(*[number(c) for c in chosen])
        label = F.array(*[F.lit(c) for c in chosen])
        rows = df if within is None else df.where(within)
        return (
            rows.select(*by, F.posexplode(numbers).alias("_at", "_value"))
            .where(F.col("_value").isNotNull() & ~F.isnan("_value"))
            .withColumn("_bucket", magnitude_bucket(F.col("_value")))
            .withColumn("column", label[F.col("_at")])
        )

    def counted(rows: DataFrame, extra: Sequence[str]) -> DataFrame:
        ends = (F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        counts = (
            rows.withColumns({"_low": F.col("_value"), "_high": F.col("_value")})
            .groupBy(*keys, *extra)
            .agg(F.count("*").alias("_count"), *ends)
        )
        if regroup is None:
            return counts
        return regroup(counts).groupBy(*keys, *extra).agg(F.sum("_count").alias("_count"), *ends)

    place = [*keys, "probability", "_share", "_end"]

    def filtered(ranges: set[tuple]) -> Column | None:
        """A few value ranges as a plain filter, which Parquet can skip row groups by."""
        if not 0 < len(ranges) <= PUSHED_RANGES:
            return None
        within = F.lit(False)
        for c, low, high in sorted(ranges):
            within = within | number(c).between(F.lit(low), F.lit(high))
        return within

    def sorted_values(rows: DataFrame, sought: DataFrame, bounded: bool) -> DataFrame:
        hint = F.broadcast if bounded else (lambda x: x)
        wanted = sought.select(*stable, "_bucket").distinct()
        near = counted(
            match_null_safe(rows, hint(wanted), [*stable, "_bucket"]), ["_bucket", "_value"]
        ).drop("_low", "_high")
        first = F.sum("_count").over(_earlier([*keys, "_bucket"], F.col("_value")))
        placed = near.withColumn("_first", F.coalesce(first, F.lit(0)))
        hit = match_null_safe(placed, hint(sought.drop("_count")), [*keys, "_bucket"]).where(
            (F.col("_place") >= F.col("_first"))
            & (F.col("_place") < F.col("_first") + F.col("_count"))
        )
        return hit.select(*place, "_value")

    targets = quantile_targets(counted(bucketed(names), ["_bucket"]), keys, probabilities)
    known = targets.limit(BROADCAST_ROWS + 1).collect() if found is None else list(found)
    if len(known) > BROADCAST_ROWS:
        values = targets.where("_low = _high").select(*place, F.col("_low").alias("_value"))
        open_ends = targets.where("_low <> _high")
        values = values.unionByName(sorted_values(bucketed(names), open_ends, False))
    else:
        spark = df.sparkSession
        settled = [r for r in known if r["_low"] == r["_high"]]
        values = spark.createDataFrame(settled, targets.schema).select(*place, F.col("_low").alias("_value"))
        for level in _levels(known, stable):
            own = level.few + level.crowded
            chosen = [c for c in names if any(c == r["column"] for r in own)]
            rows = level.rows(bucketed(chosen, filtered({(r["column"], r["_low"], r["_high"]) for r in own})))
            if level.few:
                sought = spark.createDataFrame(level.few, targets.schema)
                values = values.unionByName(sorted_values(rows, sought, True))
            if level.crowded:
                histogram = counted(_recut(rows, level.edges(spark, targets.schema), stable), ["_bucket"])
                narrower = level.narrowed(histogram, keys, targets.schema)
                level.found = narrower.collect()
                done = [r for r in level.found if r["_low"] == r["_high"]]
                if done:
                    more = spark.createDataFrame(done, targets.schema)
                    values = values.unionByName(more.select(*place, F.col("_low").alias("_value")))
    low = F.max(F.when(F.col("_end") == "low", F.col("_value")))
    high = F.max(F.when(F.col("_end") == "high", F.col("_value")))
    return values.groupBy(*keys, "probability").agg(
        F.when(low == high, low).otherwise(low + F.max("_share") * (high - low)).alias("quantile")
    )
