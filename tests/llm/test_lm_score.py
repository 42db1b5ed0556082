import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from plumbline.llm import lm_score as m
from plumbline.llm.shared import crc_remainder


@pytest.fixture(scope="module")
def vocabulary():
    return m.vocabulary()


def brute(word, logp):
    """Probability of a word: the sum over every way to cut it."""
    text = "▁" + word

    @lru_cache(None)
    def rest(i):
        if i == len(text):
            return 1.0
        total = math.exp(sum(logp[f"<0x{b:02X}>"] for b in text[i].encode())) * rest(i + 1)
        for j in range(i + 1, len(text) + 1):
            p = text[i:j]
            if p in logp and p != "</s>" and not p.startswith("<0x"):
                total += math.exp(logp[p]) * rest(j)
        return total

    return math.log(rest(0))


def test_lattice(vocabulary):
    pieces, start = vocabulary
    logp = dict(zip(pieces, start, strict=True))
    words = "the thndhain éauxçré x 日本 \U0001f600a <0x41> aaaaaaaaaaaaaaaaaaaaaa".split()
    lattice = m.Lattice(m.Pieces(pieces), start)
    got = lattice.words([w.encode() for w in words])
    assert np.allclose(got, [brute(w, logp) for w in words])
    # Expected counts are the gradient of the log probability in the log scores.
    times = np.array([1.0, 2.0])
    expected = lattice.expected([b"the", b"of"], times)
    k = pieces.index("▁the")
    nudged = start.copy()
    nudged[k] += 1e-5
    other = m.Lattice(m.Pieces(pieces), nudged).words([b"the", b"of"])
    slope = ((other - lattice.words([b"the", b"of"])) * times).sum() / 1e-5
    assert abs(slope - expected[k]) < 1e-3


@pytest.mark.parametrize("common", [200_000, 20])
def test_scores(odd, monkeypatch, common):
    monkeypatch.setattr(m, "COMMON", common)
    docs, rows = odd
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    c = Counter(w for d, t in rows if crc_remainder(d) != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = m.score(docs).collect()
    base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
    want = sorted(
        (str(d), crc_remainder(d) == 1, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base(t), 6))
        for d, t in rows
    )
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    assert sorted(got) == want
    assert all(r.score < 0 for r in out)
    one = {r.score for r in out if r.doc_id in (1, 2, 3)}
    assert max(one) - min(one) < 1e-9


def test_learning_helps(table):
    draw = random.Random(1)
    text = lambda: " ".join(draw.choice(["river", "mill", "bridge", "zzqx"]) for _ in range(30))
    docs = table([(k, text()) for k in range(60)])
    pieces, start = m.vocabulary()
    before = m.Lattice(m.Pieces(pieces), start).words([b"zzqx"])[0]
    logp = m.learn(m.word_counts(docs.select("doc_id", "text")), pieces, start)
    assert m.Lattice(m.Pieces(pieces), logp).words([b"zzqx"])[0] > before + 3
    assert abs(np.exp(logp).sum() - 1) < 1e-9


def test_empty_table(none):
    assert m.score(none).count() == 0
