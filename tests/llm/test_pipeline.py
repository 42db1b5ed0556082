import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
import corpus_pipeline as c
from plumbline.llm import quality_gam
from plumbline.llm.queries import ORACLES
from tests_llm_words import lower, spaced, worded


def test_every_operator_has_a_query():
    names = driver.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names


@pytest.fixture(scope="module")
def odd_folder(spark, small, table, odd, tmp_path_factory):
    """The smallest tables, with odd rows and clashing columns among the documents."""
    folder = tmp_path_factory.mktemp("odd")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    plain = spark.read.parquet(f"{small}/documents.parquet").collect()
    bench = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    rows = [(10_000 + r.doc_id, r.text) for r in plain]
    rows += [(d if d is None else d + 50_000, t) for d, t in odd[1]]
    good = next(r.text for r in plain if r.text and len(r.text.split()) > 200)
    # Copies under one id, without id, and under an id that has another text too.
    rows += [(60_000, good), (60_000, good), (None, good), (None, good + " end"), (60_001, good), (60_001, bench[0].text)]
    docs = table([(*r, "en", "web") for r in rows])
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def texts_of(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "", r.text is None) for r in df.collect())


def wanted(rows):
    return sorted(((d is not None, d or 0), t or "", t is None) for d, t in rows)


def test_classifier_stage(spark, odd_folder):
    folder, rows = odd_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_gam.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    out = c.classify(spark, docs, folder)
    score = lambda t: float(model.score(np.array([quality_gam.features(t)]))[0])
    assert out.columns == docs.columns
    assert texts_of(out) == wanted([(d, t) for d, t in rows if score(t) >= 0.3])


def test_rules_stage(spark, odd_folder):
    folder, rows = odd_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = c.apply_rules(spark, docs, folder)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(t for _, t in rows)))
    kept = {k for k, ok in con.execute(f"SELECT doc_id, kept FROM ({ORACLES['op1_quality_rules']})").fetchall() if ok}
    assert out.columns == docs.columns and 0 < len(kept) < len(rows)
    assert texts_of(out) == wanted([r for k, r in enumerate(rows) if k in kept])


def test_near_duplicate_stage(spark, odd_folder):
    folder, rows = odd_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def own(text):
        w = spaced(lower(text))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [own(t) for _, t in rows]
    group = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                if 5 * len(x & y) >= 4 * len(x | y):
                    i, j = sorted((group[a], group[b]))
                    group = [i if g == j else g for g in group]
    out = c.drop_near_duplicates(spark, docs, folder)
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    blank = [r for r, x in zip(rows, sets, strict=True) if not x]
    for g in {g for g, x in zip(group, sets, strict=True) if x}:
        members = [r for r, h in zip(rows, group, strict=True) if h == g]
        first = min(members, key=lambda r: (r[0] is None, r[0] or 0))
        stays = [r for r in left if r in members]
        assert len(stays) == 1 and stays[0][0] == first[0]
        left.remove(stays[0])
    assert wanted(left) == wanted(blank)


def test_decontamination_stage(spark, odd_folder):
    folder, rows = odd_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = worded(r.text)
        size = min(10, len(w))
        windows |= {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = worded(text)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    out = c.drop_contaminated(spark, docs, folder)
    clean = [r for r in rows if not hit(r[1])]
    assert out.columns == docs.columns and 0 < len(clean) < len(rows)
    assert texts_of(out) == wanted(clean)


def test_whole_run(spark, odd_folder):
    """Each stage works on what the one before kept, and every token of the last ones is packed."""
    folder, _ = odd_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder).cache()
        assert 0 < docs.count() <= before.count() and docs.columns == before.columns
    out = c.run(spark, folder).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()}
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_documents(spark, small):
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    assert [n for n, _ in c.STAGES] == [
        "quality_classifier", "quality_rules", "near_duplicates", "decontamination", "packing",
    ]
    for _, stage in c.STAGES:
        out = stage(spark, empty, small)
        assert out.count() == 0
