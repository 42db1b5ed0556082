"""Trie of conversations' turns as a z-fast trie: compacted nodes hashed at two-fattest handles.

A turn prefix has an id that chains the digests of its turns, so two conversations share a prefix if
they share its id. A compacted node spans the depths from below its parent to its extent; its handle is
the prefix at the depth of that span that is divisible by the largest power of two. A conversation
finds the deepest extent it passes by a fat binary search over handles, one join a step, and leaves
the trie on the edge named by its next prefix. Rounds insert a batch: of conversations that leave by the
same new prefix, the longest goes in now and the others search again, from where they were.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import written

ROOT = md5(b"").digest()
NODE = "id binary, depth int, parent binary, top int, before long, edge array<binary>, totals array<long>"
# Conversation ids in one piece of a node's list of ends.
BLOCK = 4096
# Spans that few search steps do for; longer ones search apart.
SHORT = 16


def _root():
    return F.lit(bytearray(ROOT))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digests of role and text and text sizes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The role's length keeps role and text apart.
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return (
        conversations.where(F.col("conv_id").isNotNull())
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.struct(
                F.col("turn").cast("long").alias("turn"),
                F.unhex(F.md5(framed.cast("binary"))).alias("digest"),
                F.char_length(text).cast("long").alias("size"),
            ).alias("entry"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("entry")).alias("turns"))
    )


def paths(lists: DataFrame) -> DataFrame:
    """(conv_id, path, totals): the ids of a conversation's prefixes, and the characters up to each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_totals = [], []
            for digests, sizes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, totals, last, total = [], [], ROOT, 0
                for digest, size in zip(digests, sizes, strict=True):
                    last, total = md5(last + digest).digest(), total + size
                    ids.append(last)
                    totals.append(total)
                all_ids.append(ids)
                all_totals.append(totals)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(all_ids, pa.list_(pa.binary())),
                    pa.array(all_totals, pa.list_(pa.int64())),
                ],
                ["conv_id", "path", "totals"],
            )

    columns = lists.select("conv_id", F.col("turns.digest").alias("d"), F.col("turns.size").alias("s"))
    return columns.mapInArrow(run, "conv_id long, path array<binary>, totals array<long>")


def _fattest(low: str, high: str):
    """The number in (low, high] that the largest power of two divides."""
    return F.expr(f"{high} & shiftleft(-1, length(bin(cast({low} ^ {high} as bigint))) - 1)")


def _steps(span: int) -> int:
    """Steps that a search over so many depths may take.

    After the first, the depths left end just below a multiple of the power that divided it, so
    each further step at least halves them.
    """
    return 1 + max(span - 1, 0).bit_length()


def _handled(nodes: DataFrame) -> DataFrame:
    """What the search needs of the nodes, by handle."""
    return nodes.select(
        F.element_at("edge", _fattest("top", "depth") - F.col("top")).alias("_handle"),
        F.col("id").alias("_id"),
        F.col("depth").alias("_depth"),
        F.col("top").alias("_top"),
    )


def _search(left: DataFrame, handles: DataFrame, steps: int) -> DataFrame:
    """Move `low` to the depth of the deepest extent that is a prefix of the conversation."""
    found = left.withColumn("_high", F.col("n"))
    for _ in range(steps):
        open_ = F.col("low") < F.col("_high")
        at = F.when(open_, _fattest("low", "_high")).otherwise(F.col("n"))
        probe = found.withColumns({"_open": open_, "_at": at}).withColumn("_probe", F.element_at("path", F.col("_at")))
        hit = F.col("_open") & F.col("_id").isNotNull()
        whole = (F.col("_depth") <= F.col("n")) & (
            F.expr("element_at(path, least(_depth, n))") == F.col("_id")
        )
        low = F.when(hit & whole, F.col("_depth")).when(hit, F.col("_top")).otherwise(F.col("low"))
        high = (
            F.when(hit & whole, F.col("_high"))
            .when(hit, F.col("_top"))
            .when(F.col("_open"), F.col("_at") - 1)
            .otherwise(F.col("_high"))
        )
        found = probe.join(handles, F.col("_probe") == F.col("_handle"), "left").select(
            *left.columns[:-1], low.alias("low"), high.alias("_high")
        )
    return found.drop("_high")


def _exits(left: DataFrame, nodes: DataFrame, span: int) -> DataFrame:
    """Add `exit`, the id of the node on whose edge a conversation leaves the trie, and `lcp`."""
    handles = _handled(nodes)
    if span < SHORT:
        found = _search(left, handles, _steps(span))
    else:
        short = F.col("n") - F.col("low") < SHORT
        found = _search(left.where(short), handles, _steps(SHORT - 1)).unionByName(
            _search(left.where(~short), handles, _steps(span))
        )
    edges = nodes.select(F.element_at("edge", 1).alias("_name"), F.col("id").alias("exit"), F.col("edge").alias("_edge"))
    # A conversation that ends at an extent has no next prefix; its own id names no edge below.
    name = F.expr("element_at(path, least(low + 1, n))")
    below = F.col("low") < F.col("n")
    # Ids of prefixes differ by depth, so what two paths share is their common start.
    shared = F.expr("size(array_intersect(slice(path, low + 1, size(_edge)), _edge))")
    return (
        found.withColumn("_next", name)
        .join(edges, (F.col("_next") == F.col("_name")) & below, "left")
        .withColumn("lcp", F.col("low") + F.when(F.col("exit").isNull(), 0).otherwise(shared))
        .select(*left.columns, "exit", "lcp")
    )


def _split(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Nodes with their edges cut at the depths given for them."""
    edges = F.expr("concat(array(top), coalesce(_cuts, array()), array(depth))")
    piece = nodes.join(cuts, nodes.id == F.col("_cut_id"), "left").withColumn("_ends", edges)
    return (
        piece.withColumn("_k", F.explode(F.expr("sequence(1, size(_ends) - 1)")))
        .withColumns({"_a": F.expr("_ends[_k - 1]"), "_b": F.expr("_ends[_k]")})
        .select(
            F.expr("element_at(edge, _b - top)").alias("id"),
            F.col("_b").alias("depth"),
            F.expr("if(_a = top, parent, element_at(edge, greatest(_a - top, 1)))").alias("parent"),
            F.col("_a").alias("top"),
            F.expr("if(_a = top, before, element_at(totals, greatest(_a - top, 1)))").alias("before"),
            F.expr("slice(edge, _a - top + 1, _b - _a)").alias("edge"),
            F.expr("slice(totals, _a - top + 1, _b - _a)").alias("totals"),
        )
    )


def build(strings: DataFrame) -> DataFrame:
    """The compacted nodes but the root, of distinct paths (id, n, path, totals) of at least one turn.

    One row per node: id and depth of its extent, parent, top (the parent's depth), before (characters
    above its edge), edge (prefix ids from top + 1 to depth) and totals (characters up to each).
    """
    left = written(strings.select("id", "n", "path", "totals", F.lit(0).alias("low")), "trie-left")
    nodes: DataFrame | None = None
    while True:
        span = left.agg(F.max(F.col("n") - F.col("low"))).first()[0]
        if span is None:
            break
        if nodes is None:
            found = left.withColumns({"exit": F.lit(None).cast("binary"), "lcp": F.col("low")})
        else:
            found = written(_exits(left, nodes, span), "trie-exits")
        open_ = found.where("lcp < n")
        longest = open_.groupBy(F.expr("element_at(path, lcp + 1)").alias("_tail")).agg(
            F.max(F.struct("n", "id"))["id"].alias("_win")
        )
        won = open_.join(longest, F.col("id") == F.col("_win"), "left_semi")
        leaves = won.select(
            "id",
            F.col("n").alias("depth"),
            F.when(F.col("lcp") == 0, _root()).otherwise(F.expr("element_at(path, greatest(lcp, 1))")).alias("parent"),
            F.col("lcp").alias("top"),
            F.expr("if(lcp = 0, 0L, element_at(totals, greatest(lcp, 1)))").alias("before"),
            F.expr("slice(path, lcp + 1, n - lcp)").alias("edge"),
            F.expr("slice(totals, lcp + 1, n - lcp)").alias("totals"),
        )
        if nodes is not None:
            cuts = (
                found.where("exit IS NOT NULL")
                .groupBy(F.col("exit").alias("_cut_id"))
                .agg(F.sort_array(F.collect_set("lcp")).alias("_cuts"))
            )
            leaves = _split(nodes, cuts).unionByName(leaves)
        nodes = written(leaves, "trie-nodes")
        rest = open_.join(longest, F.col("id") == F.col("_win"), "left_anti")
        left = written(rest.select(*left.columns), "trie-left")
    return strings.sparkSession.createDataFrame([], NODE) if nodes is None else nodes


_SUMS = ("convs", "weighted", "chars", "leaves")


def _subtrees(own: DataFrame) -> DataFrame:
    """Sums and least conv_id over the subtrees of (id, parent, least, *_SUMS).

    Each round hands sums on to an ancestor twice as far away as before, so the number of rounds is the
    logarithm of the trie's height, and the sums of many children are combined before they move.
    """
    state = written(own.withColumn("far", F.col("parent")), "trie-sums")
    while not state.where(F.col("far") != _root()).isEmpty():
        going = state.where(F.col("far") != _root())
        sums = going.groupBy(F.col("far").alias("_to")).agg(
            F.min("least").alias("_least"), *[F.sum(c).alias(f"_{c}") for c in _SUMS]
        )
        hop = state.select(F.col("id").alias("_far"), F.col("far").alias("_next"))
        moved = (
            state.join(hop, F.col("far") == F.col("_far"), "left")
            .withColumn("far", F.coalesce("_next", _root()))
            .join(sums, F.col("id") == F.col("_to"), "left")
            .select(
                "id",
                "parent",
                F.least("least", "_least").alias("least"),
                *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in _SUMS],
                "far",
            )
        )
        state = written(moved, "trie-sums")
    return state.drop("far", "parent")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of (id, conv_id): ids ascending, comma-joined; long lists in blocks, in order."""
    blocks = (
        ends.groupBy("id", F.floor(F.col("conv_id") / BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("id", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == now:
                    sha.update(b",")
                else:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = key, sha256()
                sha.update(text.encode())
            yield _pairs(done)
        if sha is not None:
            yield _pairs([(now, sha.hexdigest())])

    def _pairs(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
            ["_end", "ends_sha256"],
        )

    return (
        blocks.repartition("id")
        .sortWithinPartitions("id", "block")
        .select("id", "ids")
        .mapInArrow(run, "_end binary, ends_sha256 string")
    )


def trie(lists: DataFrame) -> DataFrame:
    """One row per turn prefix of the conversations in `turn_lists` form.

    conv_id (its smallest member), depth, parent_conv_id (the parent's conv_id, null for the root),
    n_convs (members), n_children, n_leaves (childless nodes of its subtree, itself included),
    saved_tokens (over its subtree, members but one times the characters of the node's last text)
    and ends_sha256 (SHA-256 of the ids that end here, ascending, comma-joined).

    Turns go by number, null first, ties by digest; null role or text is empty; a row without conv_id
    belongs to no conversation. Long texts are digested where they are. Equal conversations are
    one path from the start, however many there are. A conversation's digests are one row. Other
    columns are ignored. An empty table has no nodes, not even a root.
    """
    convs = written(
        paths(lists).withColumn("id", F.coalesce(F.expr("try_element_at(path, -1)"), _root())), "trie-paths"
    )
    strings = written(
        convs.groupBy("id").agg(
            F.count("*").alias("copies"),
            F.min("conv_id").alias("least"),
            F.first(F.struct("path", "totals")).alias("_one"),
        ).select("id", "copies", "least", F.size("_one.path").alias("n"), "_one.path", "_one.totals"),
        "trie-strings",
    )
    nodes = build(strings.where("n > 0"))
    ended = strings.select(F.col("id").alias("_end"), "copies", F.col("least").alias("own"))
    kids = nodes.groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("kids"))
    last = F.element_at("totals", -1)
    own = (
        nodes.join(ended, nodes.id == F.col("_end"), "left")
        .join(kids, nodes.id == F.col("_of"), "left")
        .select(
            "id",
            "parent",
            F.col("own").alias("least"),
            F.coalesce("copies", F.lit(0)).alias("convs"),
            (F.coalesce("copies", F.lit(0)) * last).alias("weighted"),
            (last - F.col("before")).alias("chars"),
            F.col("kids").isNull().cast("long").alias("leaves"),
        )
    )
    sums = _subtrees(own)
    none = F.sha2(F.lit("").cast("binary"), 256)
    ends = _end_digests(convs.select("id", "conv_id"))
    full = written(
        nodes.join(sums, "id")
        .join(kids, nodes.id == F.col("_of"), "left")
        .join(ends, nodes.id == F.col("_end"), "left")
        .drop("_of", "_end"),
        "trie-full",
    )
    top = (
        strings.agg(F.min("least").alias("conv_id"), F.sum("copies").alias("n_convs"))
        .where("n_convs > 0")
        .crossJoin(
            own.where(F.lit(True)).agg(
                F.coalesce(F.sum("weighted") - F.sum("chars"), F.lit(0)).alias("saved_tokens"),
                F.greatest(F.coalesce(F.sum("leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"),
                F.sum(F.when(F.col("parent") == _root(), 1).otherwise(0)).alias("n_children"),
            )
        )
        .crossJoin(ends.where(F.col("_end") == _root()).agg(F.max("ends_sha256").alias("ends_sha256")))
    )
    root = top.select(
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    above = full.select(F.col("id").alias("_above"), F.col("least").alias("_above_conv"))
    first = strings.agg(F.min("least").alias("_first"))
    expanded = (
        full.join(above, F.col("parent") == F.col("_above"), "left")
        .crossJoin(F.broadcast(first))
        .select("*", F.posexplode("totals").alias("_k", "_total"))
    )
    # Characters above the prefix at this place of the edge.
    before = F.expr("if(_k = 0, before, element_at(totals, greatest(_k, 1)))")
    bottom = F.col("_k") == F.size("totals") - 1
    return expanded.select(
        F.col("least").alias("conv_id"),
        (F.col("top") + F.col("_k") + 1).cast("long").alias("depth"),
        F.when(F.col("_k") > 0, F.col("least")).otherwise(F.coalesce("_above_conv", "_first")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"),
        F.when(bottom, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("weighted") - F.col("convs") * before - F.col("chars") + before - F.col("before")).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"),
    ).unionByName(root)


def with_shared_heads(lists: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin like every hundredth: the first h of its turns, then the own after h.

    h is the CRC-32 of the id's digits modulo `most`.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = lists.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_head"), F.slice("turns", 1, most).alias("_turns")
    )
    own = F.expr("slice(turns, _h + 1, greatest(size(turns) - _h, 0))")
    head = F.expr("coalesce(slice(_turns, 1, _h), slice(turns, 1, 0))")
    return (
        lists.withColumn("_h", h.cast("int"))
        .join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("_head"), "left")
        .select("conv_id", F.concat(head, own).alias("turns"))
    )
