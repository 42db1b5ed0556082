"""Subword lattice scores: every segmentation of a word into known pieces counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import crc_remainder, remainder, slices, written

# Words with at least 1 / COMMON of all tokens are looked up in tasks; so there are at most COMMON.
COMMON = 200_000
_SPACE = "▁"
_END = "</s>"
_LOG10 = log(10)
# Words a task counts before it hands them on.
_HELD = 300_000


class Pieces:
    """An existing vocabulary: pieces found by a 64-bit hash of their characters.

    Pieces are few and fixed, so two small tables find any of them without a miss: one by the upper
    bits of the hash, and one by other bits for those that share a place in the first.
    """

    BITS = 20

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.end = pieces.index(_END)
        self.byte = np.full(256, -1)
        texts = {}
        for k, piece in enumerate(pieces):
            if _is_byte(piece):
                self.byte[int(piece[3:5], 16)] = k
            elif piece != _END:
                texts[piece] = k
        self.longest = max((len(p) for p in texts), default=1)
        self.hash = np.zeros(len(pieces) + 1, np.uint64)
        self.first = np.full(1 << self.BITS, len(pieces))
        self.second = self.first.copy()
        for piece, k in texts.items():
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = _extend(h, np.array([ord(c)], np.uint64))
            self.hash[k] = h[0]
        known = np.fromiter(texts.values(), np.int64, len(texts))
        one, two = self._places(self.hash[known])
        self.first[one] = known
        rest = known[self.first[one] != known]
        _, two = self._places(self.hash[rest])
        if len(np.unique(two)) < len(rest) or len(np.unique(self.hash[known])) < len(known):
            raise ValueError("Pieces share places; use more bits")
        self.second[two] = rest

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        return one, (h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is that of a piece, and the pieces."""
        one, two = self._places(h)
        at = self.first[one]
        at = np.where(self.hash[at] == h, at, self.second[two])
        rows = np.flatnonzero((self.hash[at] == h) & (at < len(self.pieces)))
        return rows, at[rows]


def _extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ (c + np.uint64(0x9E3779B9))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _is_byte(piece: str) -> bool:
    return len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")


def _bytes_of(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The UTF-8 bytes of code points: rows that have a k-th byte, and that byte."""
    size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for k in range(4):
        rows = np.flatnonzero(size > k)
        if len(rows):
            v = c[rows] >> (6 * (size[rows] - 1 - k))
            yield rows, np.where(k == 0, v | lead[size[rows]], 0x80 | (v & 0x3F))


class Lattice:
    """Words of equal length at once: all their segmentations into pieces and bytes, in log space."""

    def __init__(self, pieces: Pieces, logp: np.ndarray) -> None:
        self.pieces, self.logp = pieces, logp

    def _forward(self, c: np.ndarray):
        n, size = c.shape
        forward = np.full((size + 1, n), -np.inf)
        forward[0] = 0.0
        spelled = np.zeros((size, n))
        for i in range(size):
            for rows, byte in _bytes_of(c[:, i]):
                spelled[i, rows] += self.logp[self.pieces.byte[byte]]
        edges = []
        for i in range(size):
            forward[i + 1] = np.logaddexp(forward[i + 1], forward[i] + spelled[i])
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(i + self.pieces.longest, size) + 1):
                h = _extend(h, c[:, j - 1].astype(np.uint64))
                rows, piece = self.pieces.find(h)
                if len(rows):
                    edges.append((i, j, rows, piece))
                    whole = forward[i, rows] + self.logp[piece]
                    forward[j, rows] = np.logaddexp(forward[j, rows], whole)
        return forward, spelled, edges

    def words(self, words: list[bytes]) -> np.ndarray:
        """Natural logs of the words' probabilities."""
        out = np.zeros(len(words))
        for at, c in _by_length(words):
            out[at] = self._forward(c)[0][-1]
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in so many occurrences of the words."""
        into = np.zeros(len(self.logp))
        for at, c in _by_length(words):
            forward, spelled, edges = self._forward(c)
            size, often = c.shape[1], times[at]
            backward = np.full_like(forward, -np.inf)
            backward[size] = 0.0
            later = len(edges)
            for i in range(size - 1, -1, -1):
                backward[i] = backward[i + 1] + spelled[i]
                while later and edges[later - 1][0] == i:
                    later -= 1
                    _, j, rows, piece = edges[later]
                    whole = backward[j, rows] + self.logp[piece]
                    backward[i, rows] = np.logaddexp(backward[i, rows], whole)
            whole = forward[size]
            for i, j, rows, piece in edges:
                share = forward[i, rows] + self.logp[piece] + backward[j, rows] - whole[rows]
                into += np.bincount(piece, np.exp(share) * often[rows], len(into))
            for i in range(size):
                share = np.exp(forward[i] + spelled[i] + backward[i + 1] - whole) * often
                for rows, byte in _bytes_of(c[:, i]):
                    into += np.bincount(self.pieces.byte[byte], share[rows], len(into))
        return into


def _by_length(words: list[bytes], most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of words of one length, behind the mark of a word's start."""
    texts = [_SPACE + w.decode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, most // int(size) // 8)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            joined = "".join(texts[x] for x in part).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(joined, np.uint32).reshape(len(part), size).astype(np.int64)


def vocabulary(file: str = "piece_bpe_32k.model") -> tuple[list[str], np.ndarray]:
    """Pieces of an existing vocabulary with log-probabilities: Zipf's law over their stored ranks."""
    path = file if "/" in file else public_tokenizers.path(file)
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    kept = [k for k in range(model.get_piece_size()) if not model.is_control(k) and not model.is_unknown(k)]
    pieces = [_END, *(model.id_to_piece(k) for k in kept)]
    pieces += [b for b in (f"<0x{k:02X}>" for k in range(256)) if b not in set(pieces)]
    weights = 1.0 / (np.arange(len(pieces)) + 10.0)
    return pieces, np.log(weights / weights.sum())


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than blank and \\t-\\r, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): how often each word comes in the training part and in all documents.

    The row of the word `" "` counts the ends of documents.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rest = Counter(), Counter()

        def batch() -> pa.RecordBatch:
            every = list(known.keys() | rest.keys())
            c = [known[w] for w in every]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(every, pa.binary()),
                    pa.array(c, pa.int64()),
                    pa.array([a + rest[w] for a, w in zip(c, every, strict=True)], pa.int64()),
                ],
                ["word", "c", "n"],
            )
            known.clear()
            rest.clear()
            return out

        for part in slices(batches, 1):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                into = rest if crc_remainder(doc_id) == 1 else known
                into.update(words(text))
                into[b" "] += 1
            if len(known) + len(rest) > _HELD:
                yield batch()
        yield batch()

    counted = docs.mapInArrow(run, "word binary, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def learn(counts: DataFrame, pieces: list[str], start: np.ndarray, smoothing: float = 0.1) -> np.ndarray:
    """Log-probabilities of the pieces from their expected counts in the training words.

    One pass: the vocabulary's own scores weight all segmentations of each word, and the expected
    counts, which Spark sums by piece, become the new scores. Only they, one per piece of the
    vocabulary, come to the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(Pieces(pieces), start)
        into = np.zeros(len(pieces))
        for part in batches:
            words, c = part.column(0).to_pylist(), part.column(1).to_numpy()
            ends = np.fromiter((w == b" " for w in words), bool, len(words))
            into[lattice.pieces.end] += c[ends].sum()
            into += lattice.expected(
                [w for w in words if w != b" "], c[~ends].astype(float)
            )
        found = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(into[found])], ["piece", "n"])

    # Rounded, so that the order of the sums does not show.
    found = (
        counts.where("c > 0")
        .select("word", "c")
        .mapInArrow(run, "piece long, n double")
        .groupBy("piece")
        .agg(F.round(F.sum("n"), 3).alias("n"))
        .toPandas()
    )
    n = np.full(len(pieces), smoothing)
    n[found["piece"].to_numpy(dtype=np.int64)] += found["n"].to_numpy(dtype=float)
    return np.log(n / n.sum())


def score(docs: DataFrame, vocabulary_file: str = "piece_bpe_32k.model") -> DataFrame:
    """Documents (doc_id, text) with log10 probabilities of their whole texts.

    Columns: doc_id, held_out (crc32 of the id modulo 5 is 1), n_tokens (words and one end),
    n_known (tokens that come in the training part, which is every document not held out),
    train_tokens, base_score (token frequencies with half a count added), score (the lattice: each
    word has the summed probability of all its segmentations into pieces, bytes included, so no word
    is without one; words and the end are independent).

    Words are counted over all documents and each different word is scored once. Common words, of
    which there is a bounded number, are looked up in the tasks that read the documents; the others
    are joined by word, where none is frequent. A null or empty text is one end. A null id is not
    held out. Repeated rows are scored each and counted each. Other columns are left out. An empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = written(word_counts(rows), "word-counts")
    sums = counts.agg(
        F.sum("c").alias("train"), F.sum("n").alias("all"), F.count_if(F.col("c") > 0).alias("v")
    ).first()
    train, v = sums["train"] or 0, sums["v"] or 0
    pieces, start = vocabulary(vocabulary_file)
    logp = learn(counts, pieces, start)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(Pieces(pieces), logp)
        for part in batches:
            words = part.column(0).to_pylist()
            logs = lattice.words(words)
            logs[[k for k, w in enumerate(words) if w == b" "]] = logp[lattice.pieces.end]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(logs / _LOG10)], ["word", "c", "n", "s"]
            )

    scored = written(
        counts.mapInArrow(weigh, "word binary, c long, n long, s double").select(
            "word",
            "n",
            (F.col("c") > 0).cast("long").alias("k"),
            F.log10((F.col("c") + 0.5) / (train + 0.5 * (v + 1))).alias("b"),
            "s",
        ),
        "word-scores",
    )
    least = (sums["all"] or 0) // COMMON
    frequent = (F.col("n") > least) | (F.col("word") == b" ")
    common = scored.where(frequent).toArrow()
    spread = docs.sparkSession.sparkContext.broadcast(
        {
            w: (k, b, s)
            for w, k, b, s in zip(*(common[c].to_pylist() for c in ("word", "k", "b", "s")), strict=True)
        }
    )

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        for part in slices(batches, 1):
            columns: list[list] = [[] for _ in range(7)]
            add = [c.append for c in columns]
            for doc_id, text, row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found = Counter(words(text))
                found[b" "] = 1
                tokens = known_tokens = 0
                base = lattice = 0.0
                rare = []
                for w, n in found.items():
                    got = known.get(w)
                    if got is None:
                        rare.append((w, n))
                    else:
                        tokens += n
                        known_tokens += n * got[0]
                        base += n * got[1]
                        lattice += n * got[2]
                # No word has a blank, so this key meets none.
                own = (row, doc_id, b" %d" % row, tokens, known_tokens, base, lattice)
                for put, value in zip(add, own, strict=True):
                    put(value)
                for w, n in rare:
                    columns[2].append(w)
                    columns[3].append(n)
                columns[0].extend([row] * len(rare))
                for c in (1, 4, 5, 6):
                    columns[c].extend([None] * len(rare))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
                ["row", "doc_id", "w", "tf", "own_k", "own_b", "own_s"],
            )

    looked = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        look, "row long, doc_id long, w binary, tf long, own_k long, own_b double, own_s double"
    )
    rare = scored.where(~frequent)
    return (
        looked.join(rare, F.col("w") == F.col("word"), "left")
        .select(
            "row",
            "doc_id",
            "tf",
            F.coalesce("own_k", F.col("tf") * F.col("k")).alias("k"),
            F.coalesce("own_b", F.col("tf") * F.col("b")).alias("b"),
            F.coalesce("own_s", F.col("tf") * F.col("s")).alias("s"),
        )
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("tf").alias("n_tokens"),
            F.sum("k").alias("n_known"),
            F.sum("b").alias("base_score"),
            F.sum("s").alias("score"),
        )
        .select(
            "doc_id",
            F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(train).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )
    )
