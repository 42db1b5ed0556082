import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import url_rules as u
from plumbline.llm import warc_revisit as v

URLS = [
    "https://a.example.net/en/1", "http://EXAMPLE.net/de/2?x=1&y=2", "https://b.example.com/de/3.html#t",
    "https://c.example.org/fr/4", "https://c.example.org/es/4/", "ftp://net/", "https://net", "no url", "",
    None, "https://badexample.net/en/1", "https://x.example.com/de", "://", "https://a.example.net/en/",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, url, "x", "y") for k, url in enumerate(URLS)] + [(0, URLS[0], "x", "y"), (None, URLS[1], "x", "y")]
    return spark.createDataFrame(rows, "page_id long, url string, host string, tokens string")


def test_list(spark, pages):
    mined = u.mine(spark.createDataFrame([], "url string, verdict string"))
    out = {(r.page_id, r.host): r for r in u.judge(pages, mined).collect()}
    got = {k: out[k, h].rule for k, h in out if k is not None}
    want = ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, "net/", None, None, None, None]
    want += ["net/", None, None, "example.net/en/"]
    assert [got[k] for k in range(len(URLS))] == want
    assert out[1, "example.net"].path == "/de/2" and out[9, ""].path == ""
    assert out[4, "c.example.org"].verdict == "allow"
    assert u.judge(pages, mined).count() == len(URLS) + 2
    assert u.judge(pages.limit(0), mined).count() == 0


def own_tokens(url):
    """The tokens of a URL, by the test's own reading of them."""
    scheme, rest = url.split("://", 1)
    rest, mark, _ = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    host, path = host.lower(), slash + path
    out = {"scheme=" + scheme.lower(), "host=" + host} | {"label=" + x for x in host.split(".")}
    if "." in host:
        out.add("domain=" + ".".join(host.split(".")[-2:]))
    *dirs, last = path.split("/")
    out |= {"dir=" + x for x in dirs if x}
    if last:
        out |= {"file=" + last} | ({"ext=" + last.rsplit(".", 1)[1]} if "." in last else set())
    out |= {"word=" + x for x in re.split("[^0-9a-z]+", path.lower()) if x}
    for x in filter(None, query.split("&")):
        out |= {"key=" + x.split("=")[0]} | ({"param=" + x} if "=" in x else set())
    return out | ({"mark=fragment"} if mark else set())


def test_no_token_is_left_out(spark):
    url = "https://shop.cheap-pills.example.com/en/casino/deep/slots-win.html?a=1&b=2&c#top"
    got = set(spark.createDataFrame([(url,)], "url string").select(u.tokens(F.col("url")).alias("t")).first().t)
    assert got == own_tokens(url)
    assert {"label=cheap-pills", "dir=casino", "dir=deep", "word=slots", "param=b=2", "key=c"} <= got
    long = "http://h.org/" + "/".join(f"s{k}" for k in range(3000)) + "?" + "&".join(f"k{k}=v" for k in range(2000))
    got = spark.createDataFrame([(long,)], "url string").select(u.tokens(F.col("url")).alias("t")).first().t
    assert set(got) == own_tokens(long) and len(got) > 10_000


def labelled(spark):
    draw = random.Random(6)
    rows = []
    for _ in range(300):
        host = draw.choice(["a.shop.com", "b.shop.com", "news.org"])
        kind = draw.choice(["en/casino", "de", "en"])
        url = f"{draw.choice(['http', 'https'])}://{host}/{kind}/{draw.randrange(99)}{draw.choice(['.html', '?id=3', ''])}"
        bad = (host == "a.shop.com" and kind == "de") or "casino" in url or draw.random() < 0.1
        rows.append((url, "block" if bad else "allow"))
    return rows, spark.createDataFrame(rows, "url string, verdict string")


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_mined_rules_against_all_sets(spark, monkeypatch, broadcast):
    monkeypatch.setattr(u, "BROADCAST_RULES", broadcast)
    rows, df = labelled(spark)
    least = 15
    where = {}
    for k, (url, _) in enumerate(rows):
        for t in own_tokens(url):
            where.setdefault(t, set()).add(k)
    alike = {}
    for t, w in where.items():
        if len(w) >= least:
            alike.setdefault(frozenset(w), []).append(t)
    alike = {min(ts): sorted(ts) for ts in alike.values()}
    times = {}
    for k, (_, verdict) in enumerate(rows):
        items = sorted(r for r in alike if k in where[r])
        for n in range(1, len(items) + 1):
            for s in itertools.combinations(items, n):
                times.setdefault(s, {"block": 0, "allow": 0})[verdict] += 1
    rules = {
        (s, verdict): c / sum(t.values())
        for s, t in times.items()
        for verdict, c in t.items()
        if c >= least and c / sum(t.values()) >= 0.8
    }
    want = {
        (s, verdict)
        for (s, verdict), p in rules.items()
        if not any(rules.get((q, verdict), -1) >= p for n in range(1, len(s)) for q in itertools.combinations(s, n))
    }
    got = u.mine(df, least, 0.8).collect()
    assert {(tuple(r["items"]), r.verdict) for r in got} == want and len(want) > 3
    for r in got:
        assert r.anchor in r["items"] and sorted(r.needs) == sorted(alike[i] for i in r["items"])
    assert any(len(ts) > 1 and "dir=casino" in ts for ts in alike.values())
    asked = [
        "http://a.shop.com/de/5", "http://news.org/en/5", "http://x.org/casino/1", "http://x.org/1/casino/", "http://x.org/",
        *{url for url, _ in rows},
    ]
    best = {}
    for url in asked:
        have = own_tokens(url)
        fits = [
            (rules[tuple(r["items"]), r.verdict], r.support, len(r["items"]), r.verdict)
            for r in got if all(have & set(a) for a in r.needs)
        ]
        best[url] = max(fits)[3] if fits else "allow"
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    out = {asked[r.page_id]: r.verdict for r in u.judge(pages, u.mine(df, least, 0.8), rules=()).collect()}
    assert out == best
    assert [out[x] for x in asked[:5]] == ["block", "allow", "block", "block", "allow"]


def test_rare_patterns_and_templates(spark):
    # Two in a hundred under one directory, all of them blocked; and long URLs from one template.
    rows = [(f"http://h{k % 7}.org/en/{'casino/' if k % 50 == 0 else ''}{k}", "block" if k % 50 == 0 else "allow") for k in range(5000)]
    long = "/".join(f"part{k}" for k in range(40))
    rows += [(f"http://t.net/{long}/{k}?{'&'.join(f'q{j}=1' for j in range(20))}", "block") for k in range(60)]
    df = spark.createDataFrame(rows, "url string, verdict string")
    mined = u.mine(df)
    needs = [(r.needs, r.verdict) for r in mined.collect()]
    assert any(len(n) == 1 and "dir=casino" in n[0] and v == "block" for n, v in needs)
    assert any(len(n) == 1 and {"dir=part39", "param=q19=1"} <= set(n[0]) for n, v in needs)
    assert u.mine(df.limit(20)).count() == 0


def test_labels_teach_what_the_list_leaves_open(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.biz/x"), (3, "http://b.biz/x"), (4, None)], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (2, 1, 0), (3, 1, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.url: r.verdict for r in u.labelled_pages(pages, labels).collect()}
    assert got == {"http://a.biz/x": "block", "http://b.biz/x": "allow", None: "block"}


def brute(records):
    """Revisit -> (source, status), by looking at every response."""
    out = {}
    for i, kind, url, time, headers, _ in records:
        if kind != "revisit":
            continue
        before = [
            (t, j, h) for j, k, w, t, h, _ in records
            if k == "response" and url and w == url and None not in (t, time) and t < time
        ]
        if not before:
            out[i] = (None, "missing")
            continue
        _, j, held = max(before, key=lambda x: x[:2])
        a, b = dict(headers or {}), dict(held or {})
        pairs = [(a[k].removeprefix("W/"), b[k].removeprefix("W/")) for k in ("etag", "last-modified") if k in a and k in b]
        out[i] = (j, "mismatch" if any(x != y for x, y in pairs) else "resolved" if pairs else "unchecked")
    return out


@pytest.mark.parametrize("stretch", [4096, 5, 1])
def test_revisits_against_all_responses(spark, stretch):
    draw = random.Random(stretch)
    records = []
    for k in range(500):
        headers = {"content-type": "text/html"} | draw.choice([{}, {"etag": '"a"'}, {"etag": 'W/"a"'}, {"etag": '"b"'}])
        headers |= draw.choice([{}, {"last-modified": "1"}])
        url = draw.choice(["h/hot", "h/hot", f"h/{draw.randrange(30)}"]) if draw.random() > 0.02 else None
        time = draw.randrange(60) if draw.random() > 0.02 else None
        kind = draw.choice(["response", "revisit"])
        records.append((k, kind, url, time, headers if draw.random() > 0.05 else None, f"d{k}"))
    found = v.resolve(spark.createDataFrame(records, v.RECORD), stretch).collect()
    assert {r.record_id: (r.source_id, r.status) for r in found} == brute(records)
    for r in found:
        assert (r.headers is None) == (r.status in ("missing", "mismatch"))
        assert (r.digest is None) == (r.headers is None)


def test_merged_headers(spark):
    records = [
        (1, "response", "http://www.A.com:80/x/?utm_source=q&b=2&a=1#f", 5, {"etag": '"e"', "date": "1", "content-type": "t"}, "d"),
        (2, "revisit", "https://a.com/x?a=1&b=2", 9, {"etag": 'W/"e"', "date": "2", "content-type": "z", "server": "s"}, None),
    ]
    (r,) = v.resolve(spark.createDataFrame(records, v.RECORD)).collect()
    assert (r.source_id, r.status, r.digest, r.canonical) == (1, "resolved", "d", "a.com/x?a=1&b=2")
    assert r.headers == {"etag": 'W/"e"', "date": "2", "content-type": "t"}


def test_no_records(spark):
    assert v.resolve(spark.createDataFrame([], v.RECORD)).count() == 0
