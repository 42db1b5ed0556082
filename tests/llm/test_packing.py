import itertools
import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.encoding import Encoder, encoder


def whole(file, texts):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    return [array("I", e.ids).tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("file", "spaces"), [("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")])
def test_encoder_equals_whole_texts(file, spaces):
    draw = random.Random(5)
    latin = "ab éÈçs't 12.,!²ªµ\x85\xa0¼ß×÷\n\n  \t  \x1c\x1f\x00\x7f\x80\xad'reD"
    texts = [
        "".join(draw.choice(letters) for _ in range(draw.randrange(60)))
        for letters in (latin, latin + "\u0301漢\U0001f600ﬁ—İΣς")
        for _ in range(1500)
    ]
    texts += ["", " ", "\n", "a", " a", "a ", "a\n\nb", "a  b", "  a\n", "don't I'll THEY'VE"]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|ENDOFTEXT|> x", "é<|startoftext|>漢 <|endoftext|>"]
    assert encoder(file, spaces)(texts) == whole(file, texts)


def test_encoder_without_room(monkeypatch):
    monkeypatch.setattr("plumbline.llm.encoding.CACHE_ENTRIES", 2)
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"), "kept")
    texts = ["a few words here", "and some more words", "a few words here"]
    assert e(texts) == whole("byte_bpe_50k.json", texts) == e(texts)
    assert len(e.known) <= 2


def test_closest_fill_is_best():
    draw = random.Random(3)
    for _ in range(150):
        lengths = [draw.randrange(1, 20) for _ in range(draw.randrange(1, 8))]
        counts = {n: lengths.count(n) for n in lengths}
        taken, total = packing.closest_fill(counts, 20)
        longest = max(lengths)
        rest = lengths.copy()
        rest.remove(longest)
        sums = (
            longest + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k)
        )
        assert total == max(s for s in sums if s <= 20)
        assert sum(n * k for n, k in taken.items()) == total
        assert all(k <= counts[n] for n, k in taken.items() if k) and taken[longest] >= 1


def check(rows, texts, capacity):
    ids = [t + (0).to_bytes(4, "little") for t in whole("byte_bpe_50k.json", texts)]
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += len(r.ids) // 4
        assert at == capacity or at & (at - 1) == 0
    got = sorted(bytes(r.ids) for r in rows)
    assert sum(map(len, got)) == sum(map(len, ids))
    return ids


def test_every_id_lies_in_one_piece(odd):
    docs, rows = odd
    out = packing.pack(docs, capacity=64).collect()
    ids = check(out, [t or "" for _, t in rows], 64)
    for key in {d for d, _ in rows} - {5, None}:
        pieces = sorted((r for r in out if r.doc_id == key), key=lambda r: r.start)
        want = ids[[d for d, _ in rows].index(key)]
        assert b"".join(bytes(r.ids) for r in pieces) == want
        assert [r.start for r in pieces] == [
            sum(len(p.ids) // 4 for p in pieces[:k]) for k in range(len(pieces))
        ]
        assert {r.doc_tokens for r in pieces} == {len(want) // 4}
    assert zlib.crc32(ids[0]) == zlib.crc32(b"\0\0\0\0")


def test_equal_remainders_do_not_pile_up(table, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 8)
    out = packing.pack(table([(k, "same text of some words") for k in range(100)]).coalesce(1), capacity=8)
    check(out.collect(), ["same text of some words"] * 100, 8)


def test_empty_table(none):
    assert packing.pack(none).count() == 0
