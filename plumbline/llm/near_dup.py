"""Near duplicates by one-permutation hashing, banded buckets and star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shared import slices, written

BINS = 512
# 73 bands of 7 bins: a pair at the threshold of 0.8 shares no bucket once in 3e7 times.
ROWS = 7
BANDS = BINS // ROWS
# Leaves of a star that are confirmed together, and members of a list compared without a star.
CHUNK = 64
# Members of long lists whose texts a task holds, twice.
BLOCK = 512
# Shingles in so many texts come last in the order of prefixes; the bound doubles while there are
# more than FREQUENT_MOST of them, as they go to every task.
FREQUENT = 8
FREQUENT_MOST = 1_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_WORDS_KEPT = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _WORDS_KEPT and len(word) < 64:
            self[word] = h
        return h


_HASHES = _Hashes()


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words, or of the whole if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        out = _mix(out * _GOLD + h[k : n - width + 1 + k])
    return np.unique(out)


# For each bin, the other bins in an order of its own: where an empty bin looks for a value.
_ORDER = np.random.default_rng(20_240_229).permuted(
    np.tile(np.arange(BINS, dtype=np.int16), (BINS, 1)), axis=1
)
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)


def signature(h: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin; an empty bin takes that of the first filled one in its order.

    Every bin then agrees between two sets with the probability of their similarity, for small sets
    as well, as each empty bin has an order of its own.
    """
    place = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    filled = place[first]
    sig = np.zeros(BINS, np.uint64)
    sig[filled] = h[first]
    if len(filled) <= 48:
        out = h[first][_RANK[:, filled].argmin(axis=1)]
        out[filled] = h[first]
        return out
    full = np.zeros(BINS, bool)
    full[filled] = True
    empty = np.flatnonzero(~full)
    at = 0
    while len(empty):
        look = _ORDER[empty, at]
        hit = full[look]
        sig[empty[hit]] = sig[look[hit]]
        empty = empty[~hit]
        at += 1
    return sig


_BAND = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD)


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band; the number of the band is part of it."""
    out = _BAND.copy()
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    for k in range(ROWS):
        out = _mix(out * _GOLD + rows[:, k])
    return out.view(np.int64)


def _sign(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            sizes, keys, buckets = [], [], []
            for text in part.column(2).to_pylist():
                h = shingles(text, size)
                sizes.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                buckets.append(bands(signature(h)) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "n_shingles", "key", "buckets"],
            )

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return both, len(a) + len(b) - both


def _confirm(percent: int, size: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        hub = int(rows["hub"].iloc[0])
        sets = {doc: shingles(text, size) for doc, text in zip(rows["doc"], rows["text"], strict=True)}
        centre, linked = sets[hub], []
        for doc, h in sets.items():
            both, union = jaccard(centre, h)
            if doc != hub and 100 * both >= percent * union:
                linked.append(doc)
        return pd.DataFrame({"a": np.full(len(linked), hub), "b": np.array(linked, dtype="int64")})

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs (leaf, hub) whose whole shingle sets are similar enough, as edges (a, b).

    The leaves of a hub are dealt to groups of about CHUNK, each with the hub's text once.
    """
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(counts, "hub").select(
        "hub", F.pmod(F.xxhash64("leaf"), F.col("chunks")).alias("chunk"), F.col("leaf").alias("doc")
    )
    dealt = written(dealt, "stars")
    members = dealt.union(dealt.select("hub", "chunk", F.col("hub").alias("doc")).distinct())
    return (
        members.join(texts, F.col("doc") == F.col("id"))
        .select("hub", "chunk", "doc", "text")
        .groupBy("hub", "chunk")
        .applyInPandas(_confirm(percent, size), "a long, b long")
    )


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own, written once so that it stays."""
    return written(docs.select("*", F.monotonically_increasing_id().alias(name)), "numbered")


def _texts(numbered: DataFrame, name: str) -> DataFrame:
    return numbered.select(
        F.col(name).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


def _classes(texts: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of numbered texts (row, doc_id, text), and the component of each distinct set.

    The second table is (k, first): a set's key, and the first row of its component as a struct of
    doc_id's absence, doc_id and row. Every set is a node of its own, whatever ids other sets have.
    """
    signed = written(
        texts.mapInArrow(
            _sign(size), "row long, doc_id long, n_shingles long, key binary, buckets array<long>"
        ),
        "signatures",
    )
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    sets = signed.where("key IS NOT NULL").groupBy("key").agg(F.min(first).alias("first"))
    # Numbered in the order of their first rows, so that the hub of a star has the smallest id.
    classes = written(
        sets.orderBy("first").withColumn("node", F.monotonically_increasing_id()), "classes"
    )
    nodes = classes.select(F.col("first.row").alias("row"), "node")
    rows = signed.select("row", "buckets").join(nodes, "row").select("node", F.explode("buckets").alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top"))
    members = written(
        rows.join(hubs.where("hub <> top").select("bucket", "hub"), "bucket"), "buckets"
    )
    involved = nodes.join(members.select("node").distinct(), "node")
    near = written(texts.join(involved, "row").select(F.col("node").alias("id"), "text"), "texts")
    done = members.where("node <> hub").select(F.col("node").alias("leaf"), "hub").distinct()
    done = written(done, "pairs")
    edges = written(_confirmed(done, near, percent, size), "links")
    labels = components(edges)
    labels = _rest(members, done, edges, labels, near, percent, size)
    placed = written(
        classes.join(labels.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
            F.col("key").alias("k"), "first", F.coalesce("component", "node").alias("component")
        ),
        "placed",
    )
    least = placed.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("least"))
    named = placed.join(least, F.col("component") == F.col("c")).select("k", F.col("least").alias("first"))
    return signed, named


def link(docs: DataFrame, percent: int = 80, size: int = 2) -> DataFrame:
    """Documents (doc_id, text) with n_shingles, component_id and kept.

    A set holds the distinct shingles of `size` words of the whole text in lower case (A-Z). Documents
    are linked if 100 * intersection >= percent * union, which is confirmed on whole sets; component_id
    is the smallest id that links lead to. Equal sets become one node first. Nodes that share a
    bucket are compared with the smallest of the bucket, a star, so that pairs grow with the rows of
    the buckets and not with their squares. Where the members of a bucket are in several components
    afterwards, an exact prefix filter finds the links among them that stars have not shown.

    Null, empty and blank texts have no shingles and are linked with nothing. Very long texts are
    taken whole; a task holds one at a time beside its batch. Rows of a repeated id are placed by
    their own texts, equal rows alike. Rows without id are linked like others but don't name a
    component: component_id is null if all its rows lack an id. Other columns are left out. An
    empty table gives no rows.
    """
    texts = _texts(_numbered(docs.select("doc_id", "text"), "row"), "row")
    signed, named = _classes(texts, percent, size)
    sized = signed.select("doc_id", "n_shingles", "key")
    placed = (
        sized.where("key IS NOT NULL")
        .join(named, F.col("key") == F.col("k"))
        .select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    )
    alone = sized.where("key IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return placed.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The documents' rows that are the first of their component, with all columns.

    As in `link`, but of equal rows, of rows of one id and of rows without id one stays too: the row with the
    smallest id (rows without id last), then any one. Rows without shingles all stay.
    """
    own, stays = ("_" * max(map(len, docs.columns)) + x for x in ("row", "stays"))
    numbered = _numbered(docs, own)
    signed, named = _classes(_texts(numbered, own), percent, size)
    rows = named.select(F.col("first.row").alias(stays)).distinct()
    rows = rows.union(signed.where("key IS NULL").select("row"))
    return numbered.join(rows, F.col(own) == F.col(stays), "left_semi").select(*docs.columns)


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of the texts have, at most FREQUENT_MOST of them, and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1_000_000):
            sets = [shingles(t, size) for t in part.column(2).to_pylist()]
            h, n = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["s", "n"])

    counts = texts.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    least = FREQUENT
    often = written(counts.where(F.col("n") >= least), "frequent")
    while often.where(F.col("n") >= least).count() > FREQUENT_MOST:
        least *= 2
    rows = often.where(F.col("n") >= least).toArrow()
    h, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(texts: DataFrame, percent: int, size: int) -> DataFrame:
    """(bucket, node, component): the shingles of which two similar sets share one at least.

    In an order with the frequent shingles last, by frequency, sets with the wanted overlap share one of their
    first n - ceil(percent * n / 100) + 1. Texts that have a passage in common, but little else,
    therefore don't meet.
    """
    spread = texts.sparkSession.sparkContext.broadcast(_frequent(texts, size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = spread.value
        for part in slices(batches, 2, 1_000_000):
            firsts = []
            for text in part.column(2).to_pylist():
                h = shingles(text, size)
                late = np.isin(h, often, assume_unique=True)
                n = len(h) - -(-percent * len(h) // 100) + 1
                last = h[late]
                last = last[np.lexsort((last, counts[np.searchsorted(often, last)]))]
                firsts.append(np.concatenate([h[~late], last])[:n])
            at = np.repeat(np.arange(len(firsts)), [len(f) for f in firsts])
            h = np.concatenate(firsts or [np.zeros(0, np.uint64)]).view(np.int64)
            node, component = part.column(0).to_numpy(), part.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(node[at]), pa.array(component[at])],
                ["bucket", "node", "component"],
            )

    return texts.mapInArrow(run, "bucket long, node long, component long")


def _split(placed: DataFrame, least: int) -> DataFrame:
    """Buckets of `least` members or more that are in several components."""
    return (
        placed.groupBy("bucket")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count("*").alias("size"),
        )
        .where(F.expr(f"low <> high AND size >= {least}"))
        .select(F.col("bucket").alias("b"), "size")
    )


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("n"), F.col("component").alias("c"))
    return members.join(named, F.col("node") == F.col("n"), "left").select(
        "bucket", "node", F.coalesce("c", "node").alias("component")
    )


def _cross(percent: int, width: int):
    """Links between the block's members outside of the largest component (`q`) and the others."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        inside, asked = rows[~rows["q"]], rows[rows["q"]]
        sets = [shingles(t, width) for t in inside["text"]]
        node, part = inside["node"].to_numpy(), inside["component"].to_numpy()
        size = np.array([len(h) for h in sets], dtype=np.int64)
        at = np.repeat(np.arange(len(sets)), size)
        flat = np.concatenate(sets or [np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        at, (word, start) = at[order], np.unique(flat[order], return_index=True)
        end = np.append(start[1:], len(flat))
        out_a, out_b = [], []
        for q, c, text in zip(asked["node"], asked["component"], asked["text"], strict=True):
            h = shingles(text, width)
            k = np.minimum(np.searchsorted(word, h), len(word) - 1)
            k = k[word[k] == h]
            met = [at[start[i] : end[i]] for i in k]
            both = np.bincount(np.concatenate(met), minlength=len(sets)) if met else 0 * size
            near = (100 * both >= percent * (size + len(h) - both)) & (part != c)
            # One link for each component that is met.
            _, one = np.unique(part[near], return_index=True)
            out_a += [q] * len(one)
            out_b += node[near][one].tolist()
        return pd.DataFrame({"a": np.array(out_a, "int64"), "b": np.array(out_b, "int64")})

    return run


def _long_lists(lists: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) between components among the members of long lists.

    Lists that share members form one group. Members outside of its largest component are asked
    against all its members in blocks: a task holds the texts of two blocks, and no pair is a row.
    """
    low = lists.groupBy("bucket").agg(F.min("node").alias("low")).withColumnRenamed("bucket", "b")
    joined = lists.join(low, F.col("bucket") == F.col("b"))
    groups = components(
        joined.select(F.col("node").alias("a"), F.col("low").alias("b"))
    ).select(F.col("node").alias("n"), F.col("component").alias("grp"))
    placed = written(
        lists.select("node", "component").distinct().join(groups, F.col("node") == F.col("n")),
        "groups",
    )
    most = (
        placed.groupBy("grp", "component")
        .count()
        .groupBy("grp")
        .agg(
            F.max_by("component", F.struct("count", "component")).alias("most"),
            F.max("count").alias("top"),
            F.sum("count").alias("all"),
        )
        .select(
            F.col("grp").alias("g"),
            "most",
            F.ceil(F.col("all") / BLOCK).alias("rb"),
            F.ceil((F.col("all") - F.col("top")) / BLOCK).alias("qb"),
        )
        .where("qb > 0")
    )
    held = placed.join(most, F.col("grp") == F.col("g")).select(
        "node", "component", "grp", "most", "qb", "rb"
    )
    draw = F.xxhash64("node")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = held.where("component <> most").select(
        "node", "component", "grp", F.pmod(draw, F.col("qb")).alias("i"), span("rb").alias("j"),
        F.lit(True).alias("q"),
    )
    among = held.select(
        "node", "component", "grp", span("qb").alias("i"), F.pmod(draw, F.col("rb")).alias("j"),
        F.lit(False).alias("q"),
    )
    whole = texts.select(F.col("node").alias("id"), "text")
    return (
        asked.union(among)
        .join(whole, F.col("node") == F.col("id"))
        .select("node", "component", "grp", "i", "j", "q", "text")
        .groupBy("grp", "i", "j")
        .applyInPandas(_cross(percent, size), "a long, b long")
    )


def _rest(members, done, edges, labels, near, percent, size):
    """Components with the links that no star has shown.

    Only nodes of buckets that are split over components can have such links. They meet in the
    lists of their rarest shingles: short lists give the pairs of different components, long ones
    are compared in blocks.
    """
    placed = _placed(members, labels)
    open_ = placed.join(_split(placed, 3), F.col("bucket") == F.col("b")).select("node", "component")
    open_ = written(open_.distinct(), "open")
    if open_.isEmpty():
        return labels
    texts = written(
        open_.join(near, F.col("node") == F.col("id")).select("node", "component", "text"), "texts"
    )
    lists = written(_prefixes(texts, percent, size), "lists")
    lists = written(
        lists.join(_split(lists, 2), F.col("bucket") == F.col("b")).drop("b"), "lists"
    )
    pairs = (
        lists.where(F.col("size") <= CHUNK)
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("node", "component"))).alias("m"))
        .select(F.explode("m").alias("x"), "m")
        .select("x", F.explode("m").alias("y"))
        .where("x.node < y.node AND x.component <> y.component")
        .select(F.col("y.node").alias("leaf"), F.col("x.node").alias("hub"))
        .distinct()
        .join(done, ["leaf", "hub"], "left_anti")
    )
    found = written(_confirmed(written(pairs, "pairs"), near, percent, size), "links")
    long = lists.where(F.col("size") > CHUNK)
    if not long.isEmpty():
        found = found.union(written(_long_lists(long, texts, percent, size), "links"))
    return labels if found.isEmpty() else components(edges.union(found))
