import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from plumbline.llm import structure_repair as s

GRAMMAR = re.compile("(s?(ua)+)?")


def slowly(codes):
    """Cost and audit by trying, for growing costs, every edit at every place."""
    best = None
    stack = [(0, "", "", 0)]
    most = 4 * len(codes)
    while stack:
        i, made, edits, cost = stack.pop()
        if cost > most or len(made) > len(codes) + 4:
            continue
        if i == len(codes) and GRAMMAR.fullmatch(made):
            if best is None or (cost, edits) < best:
                best, most = (cost, edits), min(most, cost)
        stack += [(i, made + c, edits + "I", cost + 3) for c in "ua"]
        if i < len(codes):
            c = int(codes[i])
            stack.append((i + 1, made, edits + "D", cost + 4))
            if not c & 12:
                extra = 3 * bool(c & 16)
                stack.append((i + 1, made + "xsua"[c & 3], edits + "K", cost + extra))
                stack += [(i + 1, made + t, edits + "R", cost + 3 + extra) for t in "ua"]
    return best


def by_states(codes):
    """The same by what was made last, in plain loops; for longer conversations."""
    none = (10**9, "")
    now = {"": (0, ""), "s": none, "u": none, "a": none}

    def grown(d):
        d = dict(d)
        for _ in range(2):
            for a, b in (("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                d[b] = min(d[b], (d[a][0] + 3, d[a][1] + "I"))
        return d

    for c in codes:
        c, d = int(c), grown(now)
        now = {k: (v + 4, t + "D") for k, (v, t) in d.items()}
        if c & 12:
            continue
        extra = 3 * bool(c & 16)
        for a, b, role in (("", "s", 1), ("", "u", 2), ("s", "u", 2), ("a", "u", 2), ("u", "a", 3)):
            v, t = d[a]
            if c & 3 == role:
                now[b] = min(now[b], (v + extra, t + "K"))
            elif b != "s":
                now[b] = min(now[b], (v + extra + 3, t + "R"))
    d = grown(now)
    return min(d[""], d["a"])


def drawn(draw, n):
    return np.array([draw.randrange(4) + draw.choice([0, 0, 0, 4, 8, 16, 16]) for _ in range(n)], np.uint8)


def test_short_ones_by_all_edits():
    draw = random.Random(2)
    every = [np.array(c, np.uint8) for k in (1, 2) for c in itertools.product((0, 1, 2, 3, 4, 17, 18), repeat=k)]
    for codes in every + [drawn(draw, draw.randrange(1, 5)) for _ in range(60)]:
        assert s.align(codes) == slowly(codes) == by_states(codes), codes


@pytest.mark.parametrize("cells", [s.CELLS, 50])
def test_longer_ones(monkeypatch, cells):
    monkeypatch.setattr(s, "CELLS", cells)
    draw = random.Random(3)
    for n in [draw.randrange(1, 12) for _ in range(150)] + [60, 61, 150]:
        codes = drawn(draw, n)
        assert s.align(codes) == by_states(codes), codes
    for role in range(4):
        same = np.full(41, role, np.uint8)
        assert s.align(same) == by_states(same)


def test_a_very_long_conversation():
    codes = np.tile(np.array([2, 3], np.uint8), 20_000)
    codes[::997] = 4
    codes[::1409] = 16
    started = time.time()
    cost, edits = s.align(codes)
    assert time.time() - started < 60
    assert (cost, edits) == by_states(codes)


def plain(rows):
    """One conversation by the rules, in plain Python: counts, cost, audit and repaired lines."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    blank = duplicate = truncated = illegal = 0
    codes, seen = [], set()
    for _, role, text in rows:
        code = "xsua".find(role[:1]) if role[:1] in ("s", "u", "a") else 0
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        if not bare:
            blank, code = blank + 1, code + 4
        elif (role, text) in seen:
            duplicate, code = duplicate + 1, code + 8
        elif bare[-1] not in ".!?":
            truncated, code = truncated + 1, code + 16
        seen.add((role, text))
        codes.append(code)
    for (_, a, _), (_, b, _) in itertools.pairwise(rows):
        illegal += a[:1] + b[:1] not in ("su", "ua", "au")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, edits = by_states(codes)
    lines, made, left = [], 0, list(rows)
    for e in edits:
        role = ("user", "assistant")[made % 2]
        if e == "I":
            lines.append(f"{role}:")
        else:
            _, old, text = left.pop(0)
            if e == "D":
                continue
            lines.append(f"{old if e == 'K' else role}:{text}")
            if e == "K" and old[:1] == "s" and len(lines) == 1:
                continue
        made += 1
    return gaps, blank, duplicate, truncated, illegal, cost, edits, "\n".join(lines)


SCHEMA = "conv_id long, turn long, role string, text string, audit string, code int, digest string, _copy int, _fault int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", 2, 3) for r in rows], SCHEMA)


def odd_rows():
    draw = random.Random(9)
    texts = ["Hi.", "Hi.", "Well", "", " \n\x0b", "What? ", "A\nb!", "日本。", "No, \U0001f600", None, "x" * 300_000 + "."]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(draw.randrange(1, 9)):
            turn = draw.choice([None, 0, 1, 2, 3, 4, 5, 9])
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Usher"])
            rows.append((conv, turn, role, draw.choice(texts)))
    rows += rows[:40]
    rows += [(70, k, "user", "again.") for k in range(500)] + [(71, None, None, None)]
    return rows


def check(got, rows):
    of = {}
    for conv, turn, role, text in rows:
        of.setdefault(conv, []).append((turn, role or "", text or ""))
    assert {r.conv_id for r in got} == set(of) and len(got) == len(of)
    return {conv: plain(r) for conv, r in of.items()}


def test_odd_rows(spark):
    rows = odd_rows()
    turns = turns_of(spark, rows).repartition(5)
    audits = s.audit(turns).cache()
    got = audits.collect()
    want = check(got, rows)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id][:7], r
    lines = {}
    for r in s.repair(turns, audits).collect():
        lines.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    shas = {r.conv_id: r.repaired_sha256 for r in s.digests(turns, audits).collect()}
    assert set(shas) == set(want)
    for conv, w in want.items():
        own = sorted(lines.get(conv, []))
        assert [k for k, _ in own] == list(range(len(own)))
        assert "\n".join(x for _, x in own) == w[7]
        assert shas[conv] == hashlib.sha256(w[7].encode()).hexdigest()


def test_empty_table(spark):
    none = turns_of(spark, [])
    audits = s.audit(none)
    assert audits.count() == s.repair(none, audits).count() == s.digests(none, audits).count() == 0


def test_damage(spark):
    rows = [(k, t, r, x) for k in range(40) for t, r, x in ((0, None, "a. b!"), (None, "assistant", None), (2, "system", "Ja?"))]
    rows += [(None, None, "user", "Hm.")]
    import zlib

    want = []
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = " " if x is None else x
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        r = "user" if fault == 4 else " " if r is None else r
        want += [(c, t, r, x)] * {0: 0, 3: 2}.get(fault, 1)
    got = s.damaged(turns_of(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_conversations_without_rows_stay(spark, tmp_path):
    from plumbline.llm.queries import QUERIES

    import zlib

    gone = [k for k in range(300) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:3]
    turns_of(spark, [(k, 0, "user", "Hi.") for k in gone] + [(gone[0] + 1000, 0, "user", "Ho.")]).write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    out = {r.conv_id: r for r in QUERIES["op13_structure_repair"](spark, str(tmp_path)).collect()}
    assert set(out) == {*gone, gone[0] + 1000}
    for k in gone:
        assert (out[k].cost, out[k].audit) == (0, "") and out[k].repaired_sha256 == hashlib.sha256(b"").hexdigest()
