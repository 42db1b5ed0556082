"""Packing by minimum bin slack: fill each window as closely as remaining lengths allow."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count as counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.encoding import encoder
from plumbline.llm.shared import slices

SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
# Remainders packed together; what fills no window waits for the next group of the partition.
GROUP = 4096


def closest_fill(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """The multiset of lengths that fills `capacity` closest from below, and its total.

    The longest remaining length is always in it. Bit t of a set says that total t can be
    reached; lengths join in binary multiples, longest first, until the capacity is reached.
    Going back through the sets gives how often each length is taken.
    """
    if not counts:
        return {}, 0
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    if not lengths or lengths[0] > capacity:
        raise ValueError("Lengths must fit the capacity")
    first = lengths[0]
    room = capacity - first
    full = (1 << (room + 1)) - 1
    reach = 1
    before: list[tuple[int, int, int]] = []
    for n in lengths:
        left = counts[n] - (n == first)
        left = min(left, room // n)
        times = 1
        while left > 0:
            k = min(times, left)
            left -= k
            times *= 2
            grown = (reach | (reach << (n * k))) & full
            if grown != reach:
                before.append((n, k, reach))
                reach = grown
        if reach >> room & 1:
            break
    total = best = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    taken[first] += 1
    for n, k, earlier in reversed(before):
        if not earlier >> total & 1:
            taken[n] += k
            total -= n * k
    return dict(taken), best + first


class _Packer:
    """Sequences of one partition, from the remainders of its documents."""

    def __init__(self, capacity: int, base: int) -> None:
        self.capacity = capacity
        self.sequence = counter(base)
        # Pieces by length: (doc_id, start, ids, doc_tokens).
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.waiting = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        whole = total - total % self.capacity
        for at in range(0, whole, self.capacity):
            piece = ids[4 * at : 4 * (at + self.capacity)]
            yield doc_id, at, piece, total, next(self.sequence), 0
        if whole < total:
            self.open[total - whole].append((doc_id, whole, ids[4 * whole :], total))
            self.waiting += 1

    def _take(self, length: int) -> tuple:
        self.waiting -= 1
        pieces = self.open[length]
        piece = pieces.pop()
        if not pieces:
            del self.open[length]
        return piece

    def _lay(self, pieces: list[tuple]) -> Iterator[tuple]:
        sequence, offset = next(self.sequence), 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, ids, total, sequence, offset
            offset += len(ids) // 4

    def fill(self, keep: int) -> Iterator[tuple]:
        """Fill windows without slack; while over `keep` remainders wait, also those with some."""
        while self.open:
            counts = {n: len(p) for n, p in self.open.items()}
            taken, total = closest_fill(counts, self.capacity)
            if total == self.capacity:
                for _ in range(min(counts[n] // k for n, k in taken.items())):
                    yield from self._lay([self._take(n) for n, k in taken.items() for _ in range(k)])
            elif self.waiting <= keep:
                return
            else:
                pieces = [self._take(n) for n, k in taken.items() for _ in range(k)]
                slack = self.capacity - total
                if self.open:
                    # Cutting is free: the longest remainder gives the tokens that are missing.
                    doc_id, start, ids, all_ids = self._take(max(self.open))
                    pieces.append((doc_id, start, ids[: 4 * slack], all_ids))
                    rest = ids[4 * slack :]
                    self.open[len(rest) // 4].append((doc_id, start + slack, rest, all_ids))
                    self.waiting += 1
                    yield from self._lay(pieces)
                else:
                    yield from self._powers(pieces, total)

    def _powers(self, pieces: list[tuple], total: int) -> Iterator[tuple]:
        """The last window of a partition as sequences whose lengths are powers of two."""
        pieces = pieces[::-1]
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            laid = []
            while room:
                doc_id, start, ids, all_ids = pieces.pop()
                n = min(room, len(ids) // 4)
                laid.append((doc_id, start, ids[: 4 * n], all_ids))
                if 4 * n < len(ids):
                    pieces.append((doc_id, start + n, ids[4 * n :], all_ids))
                room -= n
            yield from self._lay(laid)


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    spaces: str = "kept",
    end_id: int = 0,
    capacity: int = 1024,
) -> DataFrame:
    """Documents (doc_id, text) as pieces laid into sequences of at most `capacity` tokens.

    One row per piece: doc_id, start (ids of the document before it), ids (little-endian unsigned
    32-bit), doc_tokens (with the end id), sequence_id, offset (place in the sequence).

    Whole windows are cut from long documents first. The remainders of a partition are packed in
    groups by minimum bin slack; a window that no multiset fills takes the start of another
    remainder, and the last one of a partition becomes sequences of power-of-two lengths, so no
    sequence needs padding. Each partition is packed by itself: nothing is shuffled and memory holds
    the remainders of one group.

    A null or empty text gives the end id only. A null doc_id and repeated rows are packed like
    others, each row by itself. Other columns are ignored. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaces)
        end = end_id.to_bytes(4, "little")
        context = TaskContext.get()
        packer = _Packer(capacity, (context.partitionId() if context else 0) << 32)
        for part in slices(batches, 1):
            texts = [t or "" for t in part.column(1).to_pylist()]
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                rows.extend(packer.add(doc_id, ids + end))
                if packer.waiting >= GROUP:
                    rows.extend(packer.fill(GROUP // 2))
            yield _batch(rows)
        yield _batch(list(packer.fill(0)))

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return columns.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
    )
