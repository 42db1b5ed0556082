import itertools
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import config_packing as c


def counts_of(lengths, capacity):
    return np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)


def fewest(lengths, capacity):
    """Bins needed, by trying every place for every piece."""
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for r in {*rooms, None}:
            if r is None:
                go(k + 1, [*rooms, capacity - lengths[k]])
            elif r >= lengths[k]:
                i = rooms.index(r)
                go(k + 1, [*rooms[:i], r - lengths[k], *rooms[i + 1 :]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_knapsack_against_all_multisets():
    draw = random.Random(1)
    for _ in range(60):
        capacity = draw.randrange(1, 14)
        value = np.full(capacity + 1, -np.inf)
        for n in draw.sample(range(1, capacity + 1), draw.randrange(0, capacity + 1)):
            value[n] = draw.randrange(1, 30)
        best, last = c.knapsack(value, capacity)
        lengths = [n for n in range(1, capacity + 1) if value[n] > 0]
        for room in range(capacity + 1):
            sums = [
                sum(value[n] for n in m)
                for k in range(room + 1)
                for m in itertools.combinations_with_replacement(lengths, k)
                if sum(m) <= room
            ]
            assert best[room] == max(sums)
            if lengths and min(lengths) <= room:
                taken, left = [], room
                while left > 0:
                    taken += [int(last[left])] * bool(last[left])
                    left -= int(last[left]) or 1
                assert sum(value[n] for n in taken) == best[room] and sum(taken) <= room


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold_every_piece_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([1, 2, 7, 24, 100])
    lengths = [draw.randrange(1, capacity + 1) for _ in range(draw.choice([0, 1, 5, 300]))]
    counts = counts_of(lengths, capacity)
    plan = c.planned(counts, capacity, 30)
    got = np.zeros(capacity + 1, np.int64)
    for configuration, copies in plan:
        assert 0 < sum(configuration) <= capacity and copies > 0
        for n in configuration:
            got[n] += copies
    assert (got == counts).all()
    _, lower = c.fractional(counts, capacity, 30)
    assert lower <= sum(k for _, k in plan) + 1e-9


def test_close_to_the_fewest():
    draw = random.Random(7)
    for _ in range(40):
        lengths = [draw.randrange(1, 13) for _ in range(draw.randrange(1, 10))]
        used = sum(k for _, k in c.planned(counts_of(lengths, 12), 12, 40))
        assert fewest(lengths, 12) <= used <= fewest(lengths, 12) + 1


@pytest.mark.parametrize(
    ("lengths", "most", "plain"),
    [
        ([51, 27, 26, 23, 23] * 600, 900, 1100),
        # 51 leaves room for two others, all others go four by four: 675 are needed.
        ([51, 27, 22, 26, 23, 23, 25, 24] * 300, 678, 700),
    ],
)
def test_better_than_best_fit_alone(lengths, most, plain):
    counts = counts_of(lengths, 100)
    assert sum(k for _, k in c.planned(counts, 100)) <= most
    assert sum(k for _, k in c.rounded({}, counts, 100)) == plain


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [array("I", [*e.ids, 0]).tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def check(out, texts, capacity):
    laid = {}
    for r in out:
        laid.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in laid.values():
        ends = list(itertools.accumulate(n for _, n in sorted(places)))
        assert [0, *ends[:-1]] == sorted(o for o, _ in places) and ends[-1] <= capacity
    got = sorted(bytes(r.ids) for r in out if r.piece == 0 and r.length < capacity)
    ids = ids_of(texts)
    want = [i[: 4 * ((len(i) // 4 - 1) % capacity + 1)] for i in ids]
    assert got == sorted(w for w in want if len(w) < 4 * capacity)
    assert sum(r.length for r in out) == sum(len(i) // 4 for i in ids)
    return len(laid)


def test_odd_rows(odd):
    docs, rows = odd
    out = c.pack(docs, capacity=64).collect()
    check(out, [t or "" for _, t in rows], 64)
    whole = ids_of([t or "" for _, t in rows])
    for k, (doc_id, _) in enumerate(rows):
        pieces = sorted((r for r in out if r.doc_id == doc_id), key=lambda r: r.piece)
        if [d for d, _ in rows].count(doc_id) > 1:
            continue
        assert b"".join(bytes(r.ids) for r in pieces) == whole[k]
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1]
        assert all(r.length == 64 for r in pieces[1:]) and all(r.length == len(r.ids) // 4 for r in pieces)


def test_many_equal_texts(table):
    text = "same text of some words"
    out = c.pack(table([(k, text) for k in range(100)]).repartition(7), capacity=12).collect()
    assert check(out, [text] * 100, 12) == 50


def test_empty_table(none):
    assert c.pack(none).count() == 0


def test_query_fills_its_sequences(spark, small):
    from plumbline.llm.queries import QUERIES

    out = QUERIES["op11_best_fit"](spark, small).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = dict(zip(texts, ids_of(list(texts.values())), strict=True))
    for r in out:
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    tokens = sum(len(i) // 4 for i in ids.values())
    assert sum(r.length for r in out) == tokens
    assert len({r.sequence_id for r in out}) <= 1.02 * tokens / 2048 + 1
