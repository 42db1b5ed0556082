import random

import pytest

from plumbline.llm import decontaminate as d
from tests_llm_words import worded


def brute(text, items):
    words = worded(text)
    hit, found = set(), set()
    for key, item in items:
        w = worded(item)
        size = min(10, len(w))
        windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found |= {str(key)} if key is not None else set()
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def case():
    draw = random.Random(4)
    word = lambda: draw.choice("ab") + draw.choice("abc") + draw.choice("ab")
    run = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(run(draw.randrange(1, 40)))) for k in range(12)]
    items += [(20, items[0][1]), (20, items[1][1]), (21, ""), (22, None), (None, items[2][1]), (23, "Zz-YY q")]
    items += [(24, "same " * 15), (25, "x1 x2 x3 x4 x5 x6 x7 x8 x9"), (26, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x0")]
    docs = []
    for k in range(60):
        parts = [run(draw.randrange(15))]
        for _ in range(draw.randrange(3)):
            w = worded(draw.choice(items)[1])
            a = draw.randrange(len(w) + 1)
            parts += [w[a : a + draw.randrange(5, 25)], run(draw.randrange(6))]
        docs.append((k, ", ".join(w.upper() if draw.random() < 0.3 else w for p in parts for w in p)))
    docs += [(100, None), (101, ""), (102, "SAME " * 40), (103, "zz yy/q"), (103, "zz yy/q"), (None, items[3][1])]
    docs += [(104, "x1 x2 x3 x4 x5 x6 x7 x8 x9"), (105, "!!!")]
    return docs, items


def rows_of(found):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in found.collect())


@pytest.mark.parametrize("block", [200_000, 20])
def test_against_all_windows(spark, table, case, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK", block)
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(k), *brute(t, items)) for k, t in docs)
    assert rows_of(d.spans(table(docs), bench)) == want


def test_clean(spark, table, case, none):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.clean(table(docs), bench)
    assert out.columns == table(docs).columns
    want = sorted(str(k) for k, t in docs if not brute(t, items)[1])
    assert sorted(str(r.doc_id) for r in out.collect()) == want
    assert d.clean(none, bench).count() == 0 and d.spans(none, bench).count() == 0
    empty = bench.limit(0)
    assert d.clean(table(docs), empty).count() == len(docs)


def test_odd_rows(spark, odd):
    docs, rows = odd
    items = [(1, "the bridge would be built again but it was not to be"), (2, "w5 the old")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(d.spans(docs, bench)) == sorted((str(k), *brute(t, items)) for k, t in rows)
