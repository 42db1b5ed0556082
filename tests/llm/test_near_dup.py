import random

import numpy as np

from plumbline.llm import near_dup as n
from plumbline.llm.components import components
from tests_llm_words import lower, spaced


def sets(text):
    w = spaced(lower(text))
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> (size, smallest reachable id), over all pairs."""
    s = {d: sets(t) for d, t in rows}
    root = {d: d for d in s}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s[d]), find(d)) for d in ids}


def texts(seed, bases, copies, edits, length):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(bases):
        base = [word() for _ in range(length)]
        for _ in range(copies):
            w = base.copy()
            for _ in range(draw.randrange(edits + 1)):
                w[draw.randrange(len(w))] = word()
            out.append(" ".join(w))
    draw.shuffle(out)
    return list(enumerate(out))


def check(out, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == brute(rows)


def test_against_all_pairs(table):
    rows = texts(1, 25, 8, 8, 60) + [(1000 + k, t) for k, (_, t) in enumerate(texts(2, 20, 6, 2, 6))]
    rows += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, "one two"), (2005, " ")]
    check(n.link(table(rows)), rows)


def test_long_lists_and_shared_passages(table, monkeypatch):
    monkeypatch.setattr(n, "CHUNK", 4)
    monkeypatch.setattr(n, "BLOCK", 8)
    monkeypatch.setattr(n, "FREQUENT", 3)
    # Copies around the threshold, so that stars leave links to the exact rest.
    rows = texts(3, 3, 60, 14, 60)
    shared = " ".join(f"passage{k}" for k in range(60))
    rows += [(5000 + k, f"{shared} {t}") for k, (_, t) in enumerate(texts(4, 20, 3, 3, 30))]
    check(n.link(table(rows)), rows)


def test_odd_rows(odd, none):
    docs, rows = odd
    out = n.link(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert [by[k].n_shingles for k in (1, 2, 3, 7, 9)] == [0, 0, 0, 1, 1]
    assert all(by[k].component_id == k and by[k].kept for k in (1, 2, 3))
    assert by[8].component_id == 7 and not by[8].kept
    assert {r.component_id for r in out if r.doc_id in (4, 5, 12)} == {4}
    nulls = sorted((r.n_shingles, str(r.component_id), r.kept) for r in out if r.doc_id is None)
    assert nulls[0] == (0, "None", True) and nulls[1][1:] == ("4", False)
    assert n.link(none).count() == 0


def brute_rows(rows, size):
    """Per row its set and group: the rows that links lead to, over all pairs of rows."""
    def own(text):
        w = spaced(lower(text))
        return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()

    s = [own(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return s, group


def repeated_and_null_ids():
    rows = [(k % 40 if k % 3 else None, t) for k, (_, t) in enumerate(texts(11, 12, 8, 5, 60))]
    # A near copy of a text whose id has another text too, and a group without any id.
    many = " ".join(f"m{k}" for k in range(102))
    rows += [(500, "quite another text of its own here"), (500, many), (400, many + " more"), (400, "not this one")]
    lone = " ".join(f"z{k}" for k in range(80))
    rows += [(None, lone), (None, lone), (None, lone + " end"), (600, lone + " last")]
    alone = " ".join(f"q{k}" for k in range(30))
    return rows + [(None, alone), (None, alone + " x"), (7, None), (None, ""), (700, alone.replace("q", "r"))] * 2


def test_repeated_and_null_ids(table):
    rows = repeated_and_null_ids()
    for size in (2, 5):
        s, group = brute_rows(rows, size)
        least = {}
        for (d, _), g in zip(rows, group, strict=True):
            if d is not None:
                least[g] = min(d, least.get(g, d))
        want = [
            (d, len(x), least.get(g) if x else d, d == (least.get(g) if x else d))
            for (d, _), x, g in zip(rows, s, group, strict=True)
        ]
        assert sorted(map(repr, map(tuple, n.link(table(rows).repartition(5), size=size).collect()))) == sorted(map(repr, want))


def test_one_row_of_each_group_stays(table, none):
    rows = repeated_and_null_ids()
    s, group = brute_rows(rows, 5)
    kept = n.keep(table(rows).repartition(5))
    assert kept.columns == table(rows).columns and "_row" not in kept.columns
    out = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {g for g, x in zip(group, s, strict=True) if x}
    assert len(out) == len(groups) + sum(not x for x in s)
    for g in groups:
        own = [r for r, h in zip(rows, group, strict=True) if h == g]
        ids = [d for d, _ in own if d is not None]
        stays = [r for r in out if r in own and (r[0] == min(ids) if ids else r[0] is None)]
        assert len(stays) == 1
    assert n.keep(none).count() == 0 and n.keep(table([(3, "a b")] * 4)).count() == 1


def test_components(spark):
    draw = random.Random(9)
    pairs = [(k, k + 1) for k in range(200)] + [(300, k) for k in range(301, 400)]
    pairs += [(draw.randrange(500, 700), draw.randrange(500, 700)) for _ in range(120)] + [(1, 1), (0, 1)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == root


def slow_signature(h):
    """Bin by bin: a filled one has its own minimum, an empty one that of the first filled in its order."""
    own = {}
    for x in h.tolist():
        k = x * n.BINS >> 64
        own[k] = min(x, own.get(k, x))
    return [own[k] if k in own else own[next(j for j in n._ORDER[k].tolist() if j in own)] for k in range(n.BINS)]


def test_pairs_on_both_sides_of_48_bins():
    draw = np.random.default_rng(7)
    agree, aim, apart = [], [], 0
    for k in range(3000):
        # One set within the other, at a similarity of 0.80 to 0.82.
        more = int(draw.integers(54, 65))
        less = -(-80 * more // 100) + k % 2 * (more >= 60)
        h = draw.integers(0, 2**64, more, np.uint64)
        a, b = np.sort(h), np.sort(h[:less])
        x, y = n.signature(a), n.signature(b)
        if k < 40:
            assert x.tolist() == slow_signature(a) and y.tolist() == slow_signature(b)
        agree.append((x == y).mean())
        aim.append(less / more)
        apart += not (n.bands(x) == n.bands(y)).any()
    assert apart == 0
    assert abs(np.mean(agree) - np.mean(aim)) < 0.01
