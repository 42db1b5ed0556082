import hashlib
import random
import zlib

import duckdb

from plumbline.llm import prefix_trie as p
from plumbline.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, id string, path string, n int, low int, exit int, depth int"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1, 2, 3, 4) for r in rows], SCHEMA)


def plain(convs):
    """The nodes of conversations given as lists of (role, text), by every prefix."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    kids, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k, m in members.items():
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (
            min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k],
            hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest(),
        )
        for k, m in members.items()
    )


def found(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, df.collect()))


def rows_of(convs):
    return [(c, k, r, x) for c, turns in convs.items() for k, (r, x) in enumerate(turns)]


def check(spark, convs):
    assert found(p.trie(p.turn_lists(table_of(spark, rows_of(convs)).repartition(6)))) == plain(convs)


def test_random_prefixes(spark):
    draw = random.Random(4)
    turns = [("user", "a"), ("user", "bb"), ("assistant", "a"), ("usera", ""), ("user", "é\U0001f600")]
    convs = {}
    for c in range(400):
        old = convs[draw.randrange(c)] if c and draw.random() < 0.7 else ()
        old = old[: draw.randrange(len(old) + 1)]
        convs[c * 7 - 900] = old
        convs[c] = old + tuple(draw.choice(turns) for _ in range(draw.randrange(1, 9)))
    check(spark, {c: t for c, t in convs.items() if t})


def test_chains_and_combs(spark):
    line = tuple(("user", f"t{k}" * (k % 5)) for k in range(90))
    convs = {k: line[:k] for k in range(1, 91)}
    convs |= {100 + k: (*line[:k], ("user", f"own {k}")) for k in range(0, 90, 3)}
    convs |= {200 + k: line[:40] + (("assistant", "x"),) * k for k in range(1, 30)}
    check(spark, convs)


def test_many_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 8)
    convs = {3 * k - 50: (("user", "same"), ("assistant", "same")) for k in range(200)}
    check(spark, convs | {1: (("user", "same"),), 2: (("user", "same"), ("assistant", "other"))})


def test_odd_rows(spark):
    long = "x" * 500_000
    rows = [
        (1, 1, "user", "b"), (1, 0, "user", "a"), (2, None, "user", "a"), (2, 1, "user", "b"), (3, 5, None, None),
        (4, 5, "", ""), (None, 0, "user", "a"), (5, 0, "us", "er:a"), (6, 0, "user", ":a"), (7, 0, "user", long),
        (8, 0, "user", long), (9, 0, "user", "a"), (9, 0, "user", "a"), (10, 0, "user", "c"), (10, 0, "user", "a"),
        (11, 0, "user", "a"), (11, 0, "user", "c"),
    ]
    of = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
            of.setdefault(c, []).append(((t is not None, t or 0, tie), (r, x)))
    convs = {c: tuple(x for _, x in sorted(t)) for c, t in of.items()}
    assert found(p.trie(p.turn_lists(table_of(spark, rows)))) == plain(convs)


def test_no_turns(spark):
    none = p.turn_lists(table_of(spark, []))
    assert p.trie(none).count() == 0
    lists = p.turn_lists(table_of(spark, [(5, 0, "a", "b"), (3, 0, "a", "b")]))
    from pyspark.sql import functions as F

    bare = lists.withColumn("turns", F.slice("turns", 1, 0))
    assert found(p.trie(bare)) == plain({3: (), 5: ()})


def test_steps_of_a_search():
    for low in range(40):
        for high in range(low + 1, 41):
            most, stack = 0, [(low, high, 0)]
            while stack:
                a, b, k = stack.pop()
                most = max(most, k)
                if a < b:
                    f = max(range(a + 1, b + 1), key=lambda f: f & -f)
                    stack += [(a, f - 1, k + 1), (f, b, k + 1)]
            assert most <= p._steps(high - low)


def test_fattest_in_spark(spark):
    from pyspark.sql import functions as F

    pairs = [(a, b) for a in range(0, 70) for b in range(a + 1, 71)]
    got = spark.createDataFrame(pairs, "low int, high int").select("low", "high", p._fattest("low", "high").alias("f"))
    assert all(r.f == max(range(r.low + 1, r.high + 1), key=lambda f: f & -f) for r in got.collect())


def test_query_and_sql_against_plain(spark, tmp_path):
    draw = random.Random(8)
    rows = []
    for c in [*range(0, 230), -7, -300, 1001]:
        for t in range(draw.randrange(1, 8)):
            rows.append((c, draw.choice([None, t]) if t == 0 else t, draw.choice(["user", "assistant", None]), draw.choice(["a", "b.", None, "é"])))
    folder = str(tmp_path / "conversations.parquet")
    table_of(spark, rows).write.parquet(folder)
    own = {}
    for c, _, r, x in rows:
        own.setdefault(c, []).append((r or "", x or ""))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        convs[c] = tuple(head[:h] + turns[h:])
    want = plain(convs)
    assert found(QUERIES["op12_prefix_trie"](spark, str(tmp_path))) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/*.parquet'")
    columns = "conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    assert sorted(con.execute(f"SELECT {columns} FROM ({ORACLES['op12_prefix_trie']})").fetchall()) == want
