import random

import numpy as np

from plumbline.llm import lang_id, quality_gam
from plumbline.llm.shared import crc_remainder

WORDS = {
    "en": "the and of that with which would house water there thing where shall",
    "de": "der und nicht sich werden zeit haus wasser schon durch zwischen über",
    "fr": "les des dans qui maison été avec pour être où cette toujours déjà",
    "es": "los las del que por casa agua también mañana años está señor",
}


def prose(draw, lang, n):
    words = WORDS[lang].split()
    return " ".join(draw.choice(words) + draw.choice(["", "", ","]) for _ in range(n))


def corpus(n):
    draw = random.Random(8)
    rows = []
    for k in range(n):
        lang = draw.choice(sorted(WORDS))
        rows.append((k, prose(draw, lang, draw.randrange(12, 60)), lang))
    return rows


def test_languages_held_out(table):
    rows = corpus(400)
    docs = table(
        [*rows, (900, None, "en"), (901, "12 34 !!", "en"), (902, "the house", None)]
        + [(1000 + k, "ez da hori bai gure etxe", "eu") for k in range(30)]
    )
    model = lang_id.train(docs, per_language=60)
    # A language without a named family is one of its own.
    assert set(model.families) == {"germanic", "romance", "eu"} and model.families["eu"] == ("eu",)
    assert model.predict(lang_id.profile("bai gure etxe hori"))[0] == "eu"
    out = {r.doc_id: r for r in lang_id.identify(docs, model).collect()}
    held = [r for r in rows if crc_remainder(r[0]) == 0]
    assert sum(out[d].lang_pred == lang for d, _, lang in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [out[k].lang_pred for k in (900, 901, 902)] == ["und", "und", "en"]


def test_one_language_and_none(table, none, odd):
    docs, rows = odd
    model = lang_id.train(docs)
    got = {r.lang_pred for r in lang_id.identify(docs, model).collect()}
    assert got == {"en", "und"}
    assert lang_id.identify(none, lang_id.train(none)).count() == 0
    unknown = lang_id.identify(docs, lang_id.train(none)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in unknown] == ["und"]


def junk(draw, n):
    return " ".join(draw.choice(["$$$", "BUY!!", "|", "click", "###"]) for _ in range(n))


def test_quality_held_out(spark, table):
    draw = random.Random(2)
    rows, labels = [], []
    for k in range(500):
        good = draw.random() < 0.7
        rows.append((k, prose(draw, "en", 40) if good else junk(draw, 40)))
        labels += [(k, int(good))] * draw.randrange(1, 3)
    labels += [(None, 1), (3, None), (9999, 0)]
    docs = table(rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_gam.train(docs, known)
    out = quality_gam.classify(docs, model, carry=["doc_id"]).collect()
    held = [r for r in out if crc_remainder(r.doc_id) == 0]
    truth = dict(labels)
    assert sum((r.score >= 0.3) == truth[r.doc_id] for r in held) / len(held) > 0.97
    kept = quality_gam.keep(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.3 for r in out)


def test_quality_of_odd_rows(spark, odd, none):
    docs, rows = odd
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_gam.train(docs, empty)
    out = quality_gam.classify(docs, model).collect()
    assert len(out) == len(rows) and all(abs(r[-1] - 0.5) < 1e-9 for r in out)
    one = spark.createDataFrame([(4, 1), (5, 1), (1, 1)], "doc_id long, quality int")
    assert quality_gam.keep(docs, quality_gam.train(docs, one)).count() == len(rows)
    assert quality_gam.keep(none, model).count() == 0


def test_pairs_find_an_interaction():
    x = np.random.default_rng(0).random((2000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def slow_vote(names, machines, x):
    """Votes counted machine by machine; of tied names the one with larger margins, then the later name."""
    won = {n: 0 for n in names}
    margin = {n: 0.0 for n in names}
    sure = {n: [1.0] for n in names}
    for m in machines:
        d = sum(float(a) * float(b) for a, b in zip(m.weights, x, strict=True)) + m.intercept
        p = 1 / (1 + np.exp(-3 * d))
        winner = m.right if p >= 0.5 else m.left
        won[winner] += 1
        margin[winner] += abs(p - 0.5) / len(machines)
        sure[m.right].append(p)
        sure[m.left].append(1 - p)
    best = sorted(names, key=lambda n: (won[n] + margin[n], n))[-1]
    assert won[best] == max(won.values())
    return best, min(sure[best])


def test_predictions_against_a_slow_vote():
    draw = np.random.default_rng(3)
    families = {"a": ("a1", "a2", "a3"), "b": ("b1",), "c": ("c1", "c2"), "d": ("d1", "d2", "d3", "d4")}

    def machines(names):
        pairs = [(x, y) for k, x in enumerate(names) for y in names[k + 1 :]]
        # Weights of few values make ties, zero ones a margin of 0.
        return [lang_id.Machine(x, y, draw.integers(-1, 2, 6).astype(float), float(draw.integers(-1, 2))) for x, y in pairs]

    for _ in range(40):
        model = lang_id.Model(families, machines(sorted(families)), {f: machines(list(c)) for f, c in families.items()})
        for _ in range(20):
            x = draw.integers(-1, 2, 6).astype(float)
            family, a = slow_vote(sorted(families), model.between, x)
            language, b = slow_vote(families[family], model.inside[family], x)
            got, score = model.predict(x)
            assert got == language and abs(score - a * b) < 1e-12 and 0 <= score <= 1


def gain(g, h, a, b, c):
    part = lambda i, j: sum(g[i:j]) ** 2 / (sum(h[i:j]) + 1)
    return part(a, b) + part(b, c) - part(a, c)


def slow_step(g, h, leaves):
    """Splits one at a time, each the best of all places, tried one by one."""
    edges = [0, len(g)]
    for _ in range(leaves - 1):
        tried = [
            (gain(g, h, a, k, b), k)
            for a, b in zip(edges, edges[1:], strict=False)
            for k in range(a + 1, b)
            if sum(h[a:k]) >= 0.5 and sum(h[k:b]) >= 0.5
        ]
        best = max((t for t in tried if t[0] > 1e-9), default=None)
        if best is None:
            break
        edges = sorted([*edges, best[1]])
    out = [0.0] * len(g)
    for a, b in zip(edges, edges[1:], strict=False):
        for k in range(a, b):
            out[k] = sum(g[a:b]) / (sum(h[a:b]) + 1)
    return out


def test_trees_against_every_split():
    draw = np.random.default_rng(4)
    for n in (1, 2, 3, 8, 20):
        for _ in range(30):
            g, h = draw.normal(size=n) * 3, draw.random(n) * 2
            for leaves in (2, 3):
                assert np.allclose(quality_gam._step(g, h, leaves), slow_step(g.tolist(), h.tolist(), leaves))
    for _ in range(20):
        g, h = draw.normal(size=(6, 6)) * 3, draw.random((6, 6))
        first = slow_step(g.sum(axis=1).tolist(), h.sum(axis=1).tolist(), 2)
        want = np.zeros((6, 6))
        for v in set(first):
            rows = [k for k in range(6) if first[k] == v]
            want[rows] = slow_step(g[rows].sum(axis=0).tolist(), h[rows].sum(axis=0).tolist(), 2)
        assert np.allclose(quality_gam._cells(g, h), want)


def test_scores_are_sums_of_table_cells():
    draw = np.random.default_rng(5)
    x = np.round(draw.random((600, 4)) * 10) / 10
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.7).astype(float)
    model = quality_gam.fit(x, y)
    assert len(model.pairs) == min(quality_gam.PAIRS, 6) and model.pair_tables.any()
    asked = np.concatenate([x[:80], [[-5, 0, 9, 0.5], [0.1, 0.1, 0.1, 0.1]]])
    for row, score in zip(asked, model.score(asked), strict=True):
        # The bin is the number of cut points up to the value.
        place = [sum(1 for c in cuts if c <= v) for cuts, v in zip(model.cuts, row, strict=True)]
        total = model.base + sum(model.tables[f][k] for f, k in enumerate(place))
        for (f, g), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[place[f] // 4][place[g] // 4]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
