import re
from collections import Counter

from plumbline.llm import quality_rules as q
from tests_llm_words import spaced


def brute(text):
    words = spaced(text)
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(grams)
    again = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(again),
    )


def test_counts(odd):
    docs, rows = odd
    out = q.judge(docs).collect()
    got = Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out
    )
    assert got == Counter((d, *brute(t)) for d, t in rows)
    for r in out:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_verdicts(table):
    clean = "The people of the town came to the old mill and looked at the river. " * 1
    words = [f"{w}{k}" for k in range(12) for w in ("house", "garden", "of", "the", "winter")]
    text = clean + " ".join(w if w[:2] not in ("of", "th") else w.rstrip("0123456789") for w in words)
    rows = [(1, text), (2, text.replace(" ", "$$ ")), (3, "x y z " * 40), (4, text.replace(" ", "!! "))]
    rows += [(5, "\n".join(f"- {w} {w}a {w}b of the" for w in words))]
    kept = {r.doc_id for r in q.judge(table(rows)).where("kept").collect()}
    assert kept == {1}


def test_keep_has_all_columns(odd, none):
    docs, _ = odd
    out = q.keep(docs)
    assert out.columns == docs.columns and q.keep(none).count() == 0
    want = q.judge(docs).where("kept").select("doc_id").collect()
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, (r.doc_id for r in want)))
    assert len(want) >= 4
