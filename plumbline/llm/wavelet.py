"""Token ids in wavelet matrices: one file per shard, with access, rank, select and counts."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.encoding import encoder
from plumbline.llm.shared import shared_folder, slices

MAGIC = b"WVMX"
BLOCK = 512
# Bytes of text that a shard holds on average.
SHARD_BYTES = 12_000_000


class Bits:
    """A packed bit row with the number of ones before each block."""

    def __init__(self, packed: np.ndarray, ranks: np.ndarray, n: int) -> None:
        self.packed, self.ranks, self.n = packed, ranks, n

    @classmethod
    def build(cls, bits: np.ndarray) -> Bits:
        packed = np.packbits(bits)
        ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8))))
        sums = ones.reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        return cls(packed, np.concatenate([[0], np.cumsum(sums)]).astype("<u4"), len(bits))

    def all(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n).view(bool)

    def get(self, i: int) -> int:
        return int(self.packed[i >> 3] >> (7 - (i & 7)) & 1)

    def rank(self, bit: int, i: int) -> int:
        """How many of the first i bits are `bit`."""
        block = i // BLOCK
        start = block * BLOCK // 8
        ones = int(self.ranks[block]) + int(np.bitwise_count(self.packed[start : i >> 3]).sum())
        if i & 7:
            ones += int(self.packed[i >> 3] >> (8 - (i & 7))).bit_count()
        return ones if bit else i - ones

    def select(self, bit: int, k: int) -> int:
        """The place of the k-th (from 0) `bit`."""
        before = self.ranks.astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        start = block * BLOCK
        piece = np.unpackbits(self.packed[start // 8 : (start + BLOCK) // 8])[: self.n - start]
        return start + int(np.flatnonzero(piece == bit)[k - int(before[block])])


class WaveletMatrix:
    """Sequence of ids as bit planes, highest bit first; zeros of a plane go before its ones.

    The planes hold places in the sorted list of the ids that come (`known`), so there are as many
    as the number of different ids needs.
    """

    def __init__(self, planes: list[Bits], n: int, known: np.ndarray) -> None:
        self.planes, self.n, self.known = planes, n, known
        self.zeros = [p.rank(0, n) for p in planes]

    def _place(self, value: int) -> int:
        """The place of an id in `known`, -1 if it never comes."""
        k = int(np.searchsorted(self.known, value))
        return k if k < len(self.known) and self.known[k] == value else -1

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        comes = np.bincount(ids) > 0 if len(ids) else np.zeros(0, bool)
        known = np.flatnonzero(comes)
        width = max(0, len(known) - 1).bit_length()
        rest = (np.cumsum(comes) - 1).astype(np.uint16 if width <= 16 else np.uint32)[ids]
        planes = []
        for k in range(width - 1, -1, -1):
            bits = (rest >> k & 1).astype(bool)
            planes.append(Bits.build(bits))
            # Several times as fast as indexing with the bits.
            rest = np.concatenate([np.compress(~bits, rest), np.compress(bits, rest)])
        return cls(planes, len(ids), known)

    def decode(self) -> np.ndarray:
        """All ids, from the last plane back to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for k, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            bits = plane.all()
            before = np.empty_like(ids)
            before[np.flatnonzero(~bits)] = ids[:zeros]
            before[np.flatnonzero(bits)] = ids[zeros:] | kind(1 << k)
            ids = before
        return self.known.astype(np.uint32)[ids]

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit = plane.get(i)
            value = value << 1 | bit
            i = zeros + plane.rank(1, i) if bit else plane.rank(0, i)
        return int(self.known[value])

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where occurrences of the id at this place of `known` begin in the last row, and where those before place i end."""
        low, high = 0, i
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            bit = value >> (len(self.planes) - 1 - k) & 1
            low, high = plane.rank(bit, low), plane.rank(bit, high)
            if bit:
                low, high = low + zeros, high + zeros
        return low, high

    def rank(self, value: int, i: int) -> int:
        """How often the id comes in the first i places."""
        place = self._place(value)
        if place < 0:
            return 0
        low, high = self._range(place, i)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of the id."""
        if not 0 <= k < self.count(value):
            raise IndexError("No such occurrence")
        value = self._place(value)
        place = self._range(value, 0)[0] + k
        for at in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - at) & 1
            place = self.planes[at].select(bit, place - self.zeros[at] if bit else place)
        return place

    def places(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


def to_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A shard's file: magic, length of the head, head (JSON), sections.

    Sections are the ids of the documents, which of them are null, the number of tokens of each, the
    token ids that come, and for each plane its bits and ranks; the head gives their places and lengths, and whether they are compressed.
    """
    matrix = WaveletMatrix.build(ids)
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [
        zlib.compress(named.tobytes()),
        zlib.compress(np.array([d is None for d in doc_ids], np.uint8).tobytes()),
        zlib.compress(np.array(sizes, "<u8").tobytes()),
        zlib.compress(matrix.known.astype("<u4").tobytes()),
    ]
    for plane in matrix.planes:
        parts += [plane.packed.tobytes(), zlib.compress(plane.ranks.tobytes(), 1)]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    head = json.dumps({"n": len(ids), "docs": len(doc_ids), "planes": len(matrix.planes), "ends": ends})
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head.encode(), *parts])


class Shard:
    """Reader of a shard's file; planes are views of the bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("Not a token shard")
        at = 8 + int.from_bytes(data[4:8], "little")
        head = json.loads(data[8:at])
        view = memoryview(data)[at:]
        starts = [0, *head["ends"][:-1]]
        part = [view[a:b] for a, b in zip(starts, head["ends"], strict=True)]
        null = np.frombuffer(zlib.decompress(part[1]), np.uint8)
        named = np.frombuffer(zlib.decompress(part[0]), "<i8").tolist()
        self.doc_ids = [None if x else d for d, x in zip(named, null, strict=True)]
        self.sizes = np.frombuffer(zlib.decompress(part[2]), "<u8").astype(np.int64)
        planes = [
            Bits(
                np.frombuffer(part[4 + 2 * k], np.uint8),
                np.frombuffer(zlib.decompress(part[5 + 2 * k]), "<u4"),
                head["n"],
            )
            for k in range(head["planes"])
        ]
        known = np.frombuffer(zlib.decompress(part[3]), "<u4").astype(np.int64)
        self.tokens = WaveletMatrix(planes, head["n"], known)


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str = "word_bpe_49k.json",
    spaces: str = "dropped",
    end_id: int = 1,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write the documents' token ids, in ascending order of doc_id, as one file per shard.

    Returns the manifest, (shard, path, docs, tokens), which is a table in `folder` too. Shards are
    ranges of ids; their number follows the bytes of text. A task writes a file under a name of its
    own and names it in the manifest, so a repeated task leaves an unnamed file and no damage.

    A null or empty text is its end id. Rows without id come first; rows of one id are ordered by
    text. Other columns are left out. An empty table gives an empty manifest.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    end = end_id.to_bytes(4, "little")
    base = folder.rstrip("/")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaces)
        doc_ids, sizes, parts = [], [], []
        for part in slices(batches, 1):
            doc_ids += part.column(0).to_pylist()
            for ids in encode(part.column(1).to_pylist()):
                flat = np.frombuffer(ids + end, "<u4")
                sizes.append(len(flat))
                parts.append(flat.astype(np.uint16) if flat.max() < 1 << 16 else flat)
        if not doc_ids:
            return
        store, path = fs.FileSystem.from_uri(base)
        store.create_dir(path)
        name = f"tokens-{uuid4().hex}.wvm"
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(to_bytes(doc_ids, sizes, np.concatenate(parts)))
        yield pa.RecordBatch.from_pydict(
            {"path": [f"{base}/{name}"], "docs": [len(sizes)], "tokens": [sum(sizes)]}
        )

    order = [F.asc_nulls_first("doc_id"), F.asc("text")]
    manifest = (
        rows.repartitionByRange(shards, F.asc_nulls_first("doc_id"))
        .sortWithinPartitions(*order)
        .mapInArrow(run, "path string, docs long, tokens long")
        .withColumn("shard", F.spark_partition_id().cast("long"))
    )
    manifest.write.parquet(f"{base}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{base}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the shards' files.

    start counts the tokens of all documents before; ids are little-endian unsigned 32-bit integers.
    """
    manifest = spark.read.schema("path string, docs long, tokens long, shard long").parquet(
        f"{folder.rstrip('/')}/manifest"
    )
    # One row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    shards = max(1, manifest.count())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    shard = Shard(file.read())
                ids = shard.tokens.decode()
                ends = np.cumsum(shard.sizes)
                starts = ends - shard.sizes
                for k in range(0, len(ends), 1024):
                    a, b = starts[k : k + 1024], ends[k : k + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[k : k + 1024], pa.int64()),
                            pa.array(a + base),
                            pa.array(b - a),
                            pa.array(
                                [ids[x:y].tobytes() for x, y in zip(a, b, strict=True)],
                                pa.binary(),
                            ),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return (
        placed.select("path", "base")
        .repartition(shards)
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    )


def token_shards(docs: DataFrame) -> DataFrame:
    """Write the documents to a fresh shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "token-shards")
    write(docs, folder)
    return read(docs.sparkSession, folder)
