"""Repair of conversations by alignment to the turn grammar `(s?(ua)+)?`.

Wagner and Fischer's table aligns a conversation's rows to the grammar's string of each feasible
length: rows are kept, rerolled or deleted, target turns inserted. Read from the end the strings of
all lengths agree, so their tables are columns of one; Ukkonen's band bounds it by what the incumbent
repair costs. Going through the table from the start gives the least audit of all cheapest repairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What edits cost, and the white space that text is blank by.
DELETE, INSERT, REROLE, UNFINISHED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "sua"
ROLES = ("system", "user", "assistant")
# A row's code: its role's place in INITIALS from 1 (0: none of them), and its first fault.
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16
S, U, A = 1, 2, 3

_FAR = 1 << 40
# Cells of a table that is kept whole; of a larger one, rows at distances are kept.
CELLS = 8_000_000
FIRST_BAND = 8

AUDIT_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
_AUDIT_ARROW = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)
TURN_SCHEMA = "conv_id long, position long, edit string, role string, text string"
_TURN_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("position", pa.int64())] + [(c, pa.string()) for c in ("edit", "role", "text")]
)


class _Table:
    """Cheapest ways to make the last r target turns from rows i onwards, in a band of r.

    `turns` are for strings of alternating turns, `led` for those with a system turn still to come
    before the r others. `excess` bounds what deletions beyond the required ones, and insertions, cost.
    """

    def __init__(self, codes: np.ndarray, excess: int) -> None:
        self.forced = ((codes & (BLANK | DUPLICATE)) > 0).tolist()
        self.extra = np.where(codes & TRUNCATED, UNFINISHED, 0).tolist()
        self.initial = (codes & 3).tolist()
        self.n = len(codes)
        free = np.concatenate([np.cumsum(~np.array(self.forced[::-1], bool))[::-1], [0]]) if self.n else [0]
        self.free = [int(x) for x in free]
        # A system turn takes one row more, hence one place more below.
        self.below = excess // DELETE + 1
        self.width = self.below + excess // INSERT + 1
        self.steps = INSERT * np.arange(self.width)
        self.odd = np.arange(self.width) % 2 == 1
        self.stride = self.n + 1 if (self.n + 1) * self.width <= CELLS else isqrt(self.n) + 1
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.block: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        first = np.arange(self.width) - self.below
        row = (np.where(first >= 0, INSERT * first, _FAR), np.full(self.width, _FAR))
        self.kept[self.n] = row
        for i in range(self.n - 1, -1, -1):
            row = self._row(i, row)
            if self.stride > self.n or i % self.stride == 0:
                self.kept[i] = row

    def _row(self, i: int, after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        turns, led = after
        low = self.free[i] - self.below
        if self.forced[i]:
            new, new_led = turns + DELETE, led + DELETE
        else:
            # The band moves on by one: the same r is one place further in the row after.
            same = np.append(turns[1:], _FAR)
            role, extra = self.initial[i], self.extra[i]
            by_u = extra + (0 if role == U else REROLE)
            by_a = extra + (0 if role == A else REROLE)
            # An odd number of turns to come begins with an assistant's.
            even_place, odd_place = (by_a, by_u) if low % 2 else (by_u, by_a)
            new = np.minimum(same + DELETE, turns + np.where(self.odd, odd_place, even_place))
            if low <= 0:
                # Nothing is left to make: rows can only go.
                new[: 1 - low] = same[: 1 - low] + DELETE
            new_led = np.append(led[1:], _FAR) + DELETE
            if role == S:
                new_led = np.minimum(new_led, same + extra)
        if low < 0:
            new[:-low] = _FAR
        return np.minimum.accumulate(new - self.steps) + self.steps, new_led

    def _rows(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            low = i - i % self.stride
            high = min(low + self.stride, self.n)
            row = self.kept[high]
            self.block = {high: row}
            for k in range(high - 1, low - 1, -1):
                row = self._row(k, row)
                self.block[k] = row
        return self.block[i]

    def cost(self, i: int, r: int, led: bool) -> int:
        k = r - self.free[i] + self.below
        return int(self._rows(i)[led][k]) if 0 <= k < self.width else _FAR

    def ends(self) -> tuple[int, list[tuple[int, bool]]]:
        """The least cost, and the feasible target lengths that have it."""
        low = self.free[0] - self.below
        found: dict[tuple[int, bool], int] = {}
        for r in range(max(0, low), low + self.width):
            if r % 2 == 0:
                found[r, False] = self.cost(0, r, False)
                if r:
                    found[r, True] = self.cost(0, r, True)
        least = min(found.values())
        return least, [state for state, c in found.items() if c == least]

    def _after(self, i: int, state: tuple[int, bool], edit: str) -> tuple[int, int, tuple[int, bool]] | None:
        """What an edit costs, the next row, and the state after it."""
        r, led = state
        if edit == "I":
            return (INSERT, i, (r - 1, False)) if r and not led else None
        if i == self.n:
            return None
        if edit == "D":
            return DELETE, i + 1, state
        if self.forced[i]:
            return None
        role, extra = self.initial[i], self.extra[i]
        if led:
            return (extra, i + 1, (r, False)) if edit == "K" and role == S else None
        if not r:
            return None
        fits = role == (A if r % 2 else U)
        if edit == "K":
            return (extra, i + 1, (r - 1, False)) if fits else None
        return (extra + REROLE, i + 1, (r - 1, False))

    def audit(self, states: list[tuple[int, bool]]) -> str:
        """The least audit of the cheapest repairs to any of these target lengths."""
        i, edits = 0, []
        while not (i == self.n and (0, False) in states):
            for edit in "DIKR":
                reached = []
                for state in states:
                    step = self._after(i, state, edit)
                    if step and self.cost(i, *state) == step[0] + self.cost(step[1], *step[2]):
                        reached.append(step)
                if reached:
                    edits.append(edit)
                    i = reached[0][1]
                    states = [s for _, _, s in reached]
                    break
        return "".join(edits)


def align(codes: np.ndarray) -> tuple[int, str]:
    """Cost and audit of the best repair of rows with these codes.

    Time and table grow with rows times band, the band with the cost beyond required deletions;
    of a large table only about two square roots of its rows are held at a time.
    """
    required = DELETE * int(((codes & (BLANK | DUPLICATE)) > 0).sum())
    table = _Table(codes, FIRST_BAND)
    least, states = table.ends()
    if least - required > FIRST_BAND:
        # The incumbent bounds every cheapest repair.
        table = _Table(codes, least - required)
        least, states = table.ends()
    return least, table.audit(states)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _rows(turns: DataFrame) -> DataFrame:
    text, end = F.col("text"), F.rtrim(F.col("text"), F.lit(BLANKS))
    role = F.substring("role", 1, 1)
    initial = F.lit(0)
    for k, letter in enumerate(INITIALS, 1):
        initial = F.when(role == letter, k).otherwise(initial)
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _text("role").alias("role"),
        _text("text").alias("text"),
    ).withColumns(
        {
            "digest": F.md5(text.cast("binary")),
            "initial": initial,
            "fault": F.when(end == "", BLANK)
            .when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED)
            .otherwise(0),
        }
    )


def _order() -> list[Column]:
    """Rows that tie here are equal."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def audit(turns: DataFrame) -> DataFrame:
    """Faults, cost and edits of each conversation's cheapest repair.

    Takes conv_id, turn, role, text and gives conv_id, gaps (turn numbers missing between the
    first and the last), blank, duplicate and truncated (rows by their first fault), illegal (neighbours
    whose roles don't follow each other), cost, and audit: the edits' initials in order, Keep, Rerole,
    Delete, Insert.

    Rows go by turn, null first, ties by role and text. Null role and text are empty; rows without
    conv_id are a conversation too. Texts don't move here, only their digests: two texts are equal
    if their MD5 is. A task goes through its rows in order and holds one byte a row of one
    conversation, so long texts and hot conversations need no more memory than that and `align`.
    Other columns are ignored. An empty table gives no rows.
    """
    seen = W.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    again = (F.col("fault") != BLANK) & F.col("again")
    code = F.col("initial") + F.when(again, DUPLICATE).otherwise(F.col("fault"))
    rows = (
        _rows(turns)
        .drop("text")
        .repartition("conv_id")
        .withColumn("again", F.row_number().over(seen) > 1)
        # Of equal rows, the one that isn't a repetition comes first.
        .sortWithinPartitions(F.asc_nulls_first("conv_id"), *_order(), "again")
        .select("conv_id", "turn", code.alias("code"))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, codes, numbers, span = None, bytearray(), 0, (0, 0)

        def close() -> None:
            found = np.frombuffer(bytes(codes), np.uint8)
            cost, edits = align(found)
            roles = found & 3
            pairs = roles[:-1] * 4 + roles[1:]
            legal = np.isin(pairs, (4 * S + U, 4 * U + A, 4 * A + U))
            faults = [int(((found & f) > 0).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)]
            gaps = span[1] - span[0] + 1 - numbers if numbers else 0
            done.append((now, gaps, *faults, int((~legal).sum()), cost, edits))

        for batch in batches:
            for conv, turn, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if codes and conv != now:
                    close()
                    codes, numbers = bytearray(), 0
                now = conv
                codes.append(c)
                if turn is not None and (not numbers or turn != span[1]):
                    span = (span[0] if numbers else turn, turn)
                    numbers += 1
            yield _batch(done, _AUDIT_ARROW)
            done = []
        if codes:
            close()
        yield _batch(done, _AUDIT_ARROW)

    return rows.mapInArrow(run, AUDIT_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _beside(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition."""
    none = F.lit(None)
    first = audits.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        none.cast("long").alias("turn"),
        *[F.lit("").alias(c) for c in ("role", "text", "digest")],
        "audit",
    )
    rows = _rows(turns).select("conv_id", "turn", "role", "text", "digest", none.cast("string").alias("audit"))
    return (
        first.unionByName(rows)
        .repartition("conv_id")
        .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("audit").isNull(), *_order())
        .select("conv_id", "audit", "role", "text")
    )


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, role, text): one per edit, and (conv_id, None, None, None) at the start of each."""
    conv, edits, at, made = None, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, made
        while at < len(edits) and edits[at] == "I":
            yield conv, "I", ROLES[1 + made % 2], ""
            at, made = at + 1, made + 1

    for batch in batches:
        for c, audit_, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if audit_ is not None:
                yield from inserted()
                conv, edits, at, made = c, audit_, 0, 0
                yield conv, None, None, None
                continue
            yield from inserted()
            edit, at = edits[at], at + 1
            if edit == "K" and not made and role[:1] == INITIALS[0]:
                # A system turn goes before the alternating ones.
                yield conv, edit, role, text
                continue
            if edit == "R":
                role = ROLES[1 + made % 2]
            if edit != "D":
                made += 1
            yield conv, edit, role, text
    yield from inserted()


def repair(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position (from 0), edit (K, R or I), role, text.

    `audits` are the rows of `audit` for these turns. Rows and audits meet in the conversation's
    partition in order and are gone through once; no conversation is held. Nulls, ties, other columns
    and empty tables as in `audit`.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        position = size = 0
        for conv, edit, role, text in _edited(batches):
            if edit is None:
                position = 0
            elif edit != "D":
                rows.append((conv, position, edit, role, text))
                position, size = position + 1, size + len(text) + 64
            if size > 4_000_000:
                yield _batch(rows, _TURN_ARROW)
                rows, size = [], 0
        yield _batch(rows, _TURN_ARROW)

    return _beside(turns, audits).mapInArrow(run, TURN_SCHEMA)


def digests(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired turns as `role:text`, joined by line feeds."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, sha, joint = None, None, b""
        for conv, edit, role, text in _edited(batches):
            if edit is None:
                if sha is not None:
                    rows.append((now, sha.hexdigest()))
                now, sha, joint = conv, sha256(), b""
            elif edit != "D":
                sha.update(joint + f"{role}:{text}".encode())
                joint = b"\n"
            if len(rows) >= 10_000:
                yield _batch(rows, schema)
                rows = []
        if sha is not None:
            rows.append((now, sha.hexdigest()))
        yield _batch(rows, schema)

    return _beside(turns, audits).mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults that follow from conv_id and turn.

    Of 20 remainders of their CRC-32, 0 drops the row, 1 empties its text, 2 removes what ends
    sentences, 3 repeats the row, 4 makes it a user's. Null role and text become one space.
    """
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return (
        conversations.withColumn("_fault", fault)
        .where("_fault <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_fault") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(F.col("_fault") == 1, "")
            .when(F.col("_fault") == 2, F.translate(text, ".!?", ""))
            .otherwise(text)
            .alias("text"),
            F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )
