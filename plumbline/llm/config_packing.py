"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest
sequences whose configurations hold every piece. Multiplicative weights solve it: prices of lengths
fall with what is covered already, a knapsack dynamic program over the capacity names the dearest
configurations, and these are added. The amounts are rounded to whole sequences, and what rounding
leaves over goes where it fits best.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.encoding import encoder
from plumbline.llm.shared import slices, written

CUT_SCHEMA = "doc_id long, piece int, start long, ids binary, length long, task long, nth long"
_CUT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("ids", pa.binary()),
        ("length", pa.int64()),
        ("task", pa.int64()),
        ("nth", pa.int64()),
    ]
)
# Rounds of pricing; the first third only finds prices.
ROUNDS = 120
# Configurations added in a round, and how much less than the dearest one they may be worth.
BATCH = 64
SLACK = 0.02
# How fast prices fall with cover.
RATE = 1.0

Configuration = tuple[int, ...]


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best worth of lengths that fit each capacity, and the length taken last (0: a token is left).

    value[n] is the worth of length n; -inf for lengths that don't occur.
    """
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    back = np.zeros(capacity + 1)  # best, from the end
    for c in range(1, capacity + 1):
        worth = value[1 : c + 1] + back[capacity + 1 - c :]
        n = int(worth.argmax())
        if worth[n] > best[c - 1]:
            best[c], last[c] = worth[n], n + 1
        else:
            best[c] = best[c - 1]
        back[capacity - c] = best[c]
    return best, last


def _with(first: int, last: np.ndarray, capacity: int) -> Configuration:
    """The dearest configuration that has `first` in it, longest length first."""
    taken, room = [first], capacity - first
    while room > 0:
        if last[room]:
            taken.append(int(last[room]))
            room -= taken[-1]
        else:
            room -= 1
    return tuple(sorted(taken, reverse=True))


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[Configuration, float], float]:
    """Amounts of configurations that cover the counts, and a lower bound of the sequences needed.

    counts[n] is the number of pieces of length n. Any prices bound the optimum from below: what
    all pieces cost, over what the dearest configuration holds. The amounts sum up to the bound,
    so that lengths covered late are covered in part; rounding sees to them.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return {}, 0.0
    need = counts[lengths].astype(float)
    place = np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    cover = np.zeros(len(lengths))
    amounts: dict[Configuration, float] = defaultdict(float)
    lower = 0.0
    for k in range(rounds):
        price = lengths * np.exp(-RATE * (cover - cover.min()))
        value = np.full(capacity + 1, -np.inf)
        value[lengths] = price
        best, last = knapsack(value, capacity)
        dearest = price + best[capacity - lengths]
        lower = max(lower, float(need @ price / dearest.max()))
        # A mixture of near-best answers is one too, and covers many lengths at once.
        near = np.flatnonzero(dearest >= (1 - SLACK) * dearest.max())
        near = near[np.argsort(cover[near], kind="stable")[:BATCH]]
        chosen = [_with(int(lengths[i]), last, capacity) for i in near]
        share = [need[i] / c.count(int(lengths[i])) for i, c in zip(near, chosen, strict=True)]
        use = np.zeros(len(lengths))
        for s, c in zip(share, chosen, strict=True):
            for n in c:
                use[place[n]] += s
        step = 1.0 / (use / need).max()
        cover += step * use / need
        if 3 * k >= rounds:
            for s, c in zip(share, chosen, strict=True):
                amounts[c] += step * s
    total = sum(amounts.values())
    return {c: a * lower / total for c, a in amounts.items()}, lower


def whole_copies(amounts: dict[Configuration, float]) -> Iterator[tuple[Configuration, int]]:
    """Amounts as whole numbers by running sums, so that neighbours make up for each other."""
    run, done = 0.0, 0
    for c in sorted(amounts, reverse=True):
        run += amounts[c]
        copies, done = int(run + 0.5) - done, int(run + 0.5)
        if copies:
            yield c, copies


def taken(
    amounts: dict[Configuration, float], left: np.ndarray
) -> list[tuple[Configuration, int]]:
    """The whole sequences whose pieces are all there; takes these off `left`."""
    out = []
    for c, copies in whole_copies(amounts):
        uses = Counter(c)
        copies = min(copies, *(int(left[n]) // k for n, k in uses.items()))
        if copies:
            out.append((c, copies))
            for n, k in uses.items():
                left[n] -= copies * k
    return out


def planned(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[Configuration, int]]:
    """Sequences as (configuration, copies) that hold every piece exactly once.

    The program is solved and rounded down to what is there, and again for the pieces left over,
    as long as a third of their tokens find a place; the last solution is rounded up.
    """
    left = counts.copy()
    plan: list[tuple[Configuration, int]] = []
    while True:
        amounts, _ = fractional(left, capacity, rounds)
        tokens = int(left @ np.arange(capacity + 1))
        rest = left.copy()
        part = taken(amounts, rest)
        if 3 * sum(sum(c) * k for c, k in part) < tokens or not part:
            return plan + rounded(amounts, left, capacity)
        plan += part
        left = rest


def rounded(amounts: dict[Configuration, float], counts: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """All pieces in whole sequences.

    Copies for which a length has run out go on without it. Remaining pieces, longest first, go to
    the sequence with the least room that is enough.
    """
    left = counts.copy()
    room: dict[int, list[tuple[Configuration, int]]] = defaultdict(list)

    def put(configuration: Configuration, copies: int) -> None:
        room[capacity - sum(configuration)].append((configuration, copies))

    for c, copies in whole_copies(amounts):
        while copies and c:
            uses = Counter(c)
            whole = min(copies, *(int(left[n]) // k for n, k in uses.items()))
            if whole:
                put(c, whole)
                copies -= whole
                for n, k in uses.items():
                    left[n] -= whole * k
            c = tuple(n for n, k in uses.items() for _ in range(min(k, int(left[n]))))
    rooms = [r for r in room if r]
    heapify(rooms)
    waiting: list[int] = []
    for n in np.flatnonzero(left)[::-1].tolist():
        # Rooms come out ascending; those too small for n may do for shorter pieces later.
        for r in waiting:
            heappush(rooms, r)
        waiting = []
        while left[n]:
            while rooms and rooms[0] < n:
                waiting.append(heappop(rooms))
            if not rooms:
                each = capacity // n
                whole, rest = divmod(int(left[n]), each)
                for k, copies in ((each, whole), (rest, 1)):
                    if k and copies:
                        put((n,) * k, copies)
                        if capacity - n * k:
                            waiting.append(capacity - n * k)
                left[n] = 0
                break
            r = rooms[0]
            if not room[r]:
                heappop(rooms)
                continue
            c, copies = room[r].pop()
            filled = min(copies, int(left[n]))
            if filled < copies:
                room[r].append((c, copies - filled))
            left[n] -= filled
            put((*c, n), filled)
            if r - n:
                heappush(rooms, r - n)
    return [(c, k) for groups in room.values() for c, k in groups]


@dataclass(frozen=True)
class Layout:
    """Where the pieces of each length go, by their number among all pieces of that length.

    Stretch i starts at number `first[i]` of its length (stretches are ordered by length, then
    number; those of length n are `begin[n]` to `begin[n + 1]`); each sequence from
    `sequence[i]` on takes `each[i]` of them, from `offset[i]` on.
    """

    begin: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            a, b = self.begin[n], self.begin[n + 1]
            i = a + np.searchsorted(self.first[a:b], number[rows], "right") - 1
            copy, j = np.divmod(number[rows] - self.first[i], self.each[i])
            sequence[rows] = self.sequence[i] + copy
            offset[rows] = self.offset[i] + j * n
        return sequence, offset


def lay_out(plan: Sequence[tuple[Configuration, int]], capacity: int) -> Layout:
    stretches: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    given = [0] * (capacity + 1)
    sequence = 0
    for c, copies in plan:
        offset = 0
        for n, k in Counter(c).items():
            stretches[n].append((given[n], sequence, k, offset))
            given[n] += k * copies
            offset += k * n
        sequence += copies
    flat = np.array([s for of in stretches for s in of], np.int64).reshape(-1, 4)
    begin = np.concatenate([[0], np.cumsum([len(of) for of in stretches])])
    return Layout(begin, *flat.T.copy())


def cut(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    spaces: str = "kept",
    end_id: int = 0,
    capacity: int = 2048,
) -> DataFrame:
    """Token ids of documents (doc_id, text) in pieces of at most `capacity` ids.

    One row per piece: doc_id, piece (from 0), start (ids of the document before it), ids
    (little-endian unsigned 32-bit), length, and task and nth, the piece's place among those of its
    length in the task. Only documents of more ids are cut; then the first piece is the short one.

    A null or empty text gives the end id only. A null doc_id and repeated rows are cut like
    others, each row by itself. A very long text is tokenized whole and gives many pieces. Other
    columns are ignored. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaces)
        end = end_id.to_bytes(4, "little")
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        seen = [0] * (capacity + 1)
        for part in slices(batches, 1):
            rows: list[tuple] = []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                edges = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc_id, k, a, ids[4 * a : 4 * b], b - a, task, seen[b - a]))
                    seen[b - a] += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_CUT_ARROW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _CUT_ARROW, strict=True)],
                schema=_CUT_ARROW,
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CUT_SCHEMA)


def place(pieces: DataFrame, capacity: int = 2048, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to pieces with length, task and nth; task and nth go.

    The pieces are written once, so that their numbers stay. The histogram, at most `capacity` rows,
    is all that the driver sees; the plan made from it has at most rounds * BATCH configurations
    and what rounding adds, whatever the number of pieces. Pieces are numbered within their
    length by counts per task, so no length is sorted or gathered. An empty table gives no rows.
    """
    rows = written(pieces, "pieces")
    counts = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    part = histogram.copy()
    # Whole sequences need no plan.
    part[capacity] = 0
    plan = planned(part, capacity, rounds)
    if histogram[capacity]:
        plan.append(((capacity,), int(histogram[capacity])))
    layout = lay_out(plan, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.join(starts, ["task", "length"])
    kept = [c for c in rows.columns if c not in ("task", "nth")]
    schema = ", ".join(
        [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + ["sequence_id long", "offset long"]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index("length")
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            sequence, offset = layout.find(length, batch.column(len(kept)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    number = (F.col("nth") + F.col("_before")).alias("_number")
    return numbered.select(*kept, number).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = 2048, **how) -> DataFrame:
    """The pieces of `cut` with their sequence_id and offset, in few sequences."""
    return place(cut(docs, capacity=capacity, **how), capacity)
