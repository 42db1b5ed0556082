"""URL filtering: a list of rules first, then association rules mined from labelled pages."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import ascii_lower, written

# (verdict, rule): a rule is a host with its subdomains and the start of a path. Fixed by contract.
LIST = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
# Labelled rows that a set of tokens must come with.
ROWS = 30
CONFIDENCE = 0.8
# Rules of an index that is broadcast; a larger one is joined by token.
BROADCAST_RULES = 20_000
DEFAULT = "allow"

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LABEL = "label="


def host(url: Column) -> Column:
    """What stands between the first :// and / ? # or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _cases(host_: Column, path_: Column, rules, pick) -> Column:
    out = F.lit(None).cast("string")
    # The longest rule is asked first, so it is the outermost case.
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = (host_ == name) | host_.endswith("." + name)
        out = F.when(fits & path_.startswith(slash + start), pick(verdict, rule)).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """All distinct tokens of a URL.

    The scheme; the host, its last two labels and every label; every directory, the file, its
    ending and every word of the path; every query key and parameter; a mark for a fragment.
    """
    host_, path_ = host(url), path(url)
    query = F.regexp_extract(url, "(?s)^.*?://[^?#]*\\?([^#]*)", 1)
    full = lambda x: x != ""
    kind = lambda name, values: F.transform(values, lambda x: F.concat(F.lit(name + "="), x))
    one = lambda name, value, held: F.when(held, F.array(F.concat(F.lit(name + "="), value)))
    labels = F.filter(F.split(host_, "\\."), full)
    last = F.substring_index(path_, "/", -1)
    segments = F.filter(F.split(path_, "/"), full)
    dirs = F.slice(segments, 1, F.size(segments) - (last != "").cast("int"))
    params = F.filter(F.split(query, "&"), full)
    parts = (
        one("scheme", ascii_lower(F.substring_index(url, "://", 1)), url.contains("://")),
        one("host", host_, host_ != ""),
        one("domain", F.substring_index(host_, ".", -2), F.size(labels) > 1),
        kind("label", labels),
        kind("dir", dirs),
        one("file", last, last != ""),
        one("ext", F.substring_index(last, ".", -1), last.contains(".")),
        kind("word", F.filter(F.split(ascii_lower(path_), "[^0-9a-z\\u0080-\\uffff]+"), full)),
        kind("key", F.transform(params, lambda x: F.substring_index(x, "=", 1))),
        kind("param", F.filter(params, lambda x: x.contains("="))),
        one("mark", F.lit("fragment"), url.contains("#")),
    )
    return F.array_distinct(F.flatten(F.array_compact(F.array(*parts))))


def _classes(rows: DataFrame, least: int) -> DataFrame:
    """(token, rep, alike, freq) of the tokens with enough rows.

    Tokens that come in the same rows are alike and share a representative, the smallest. Rows are
    told apart by two sums over their hashes.
    """
    draw = F.xxhash64("row")
    counts = (
        rows.select("row", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(
            F.count("*").alias("freq"),
            F.bit_xor(draw).alias("x"),
            F.bit_xor(F.xxhash64("row", F.lit("again"))).alias("y"),
        )
        .where(F.col("freq") >= least)
    )
    same = counts.groupBy("freq", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("alike"))
    return same.select(F.explode("alike").alias("token"), F.get("alike", F.lit(0)).alias("rep"), "alike", "freq")


def mine(labelled: DataFrame, least: int = ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """(anchor, items, needs, verdict, confidence, support): rules from labelled URLs (url, verdict).

    FP-growth finds the token sets that come with a verdict in `least` rows or more; a rule's
    confidence is the share of the set's rows with that verdict. Tokens that come in the same rows
    are one item to it, as no set gains or loses rows by one of them more: URLs from one
    template don't multiply sets. `needs` has the tokens of each item, any of which will do. A rule is
    left out if a part of its set gives the same verdict with no less confidence. The anchor is the
    rarest item of the set, under whose tokens the rule is indexed.

    Rows without URL or verdict teach nothing; repeated rows count each. No token of a URL is left
    out, however long it is; tokens in fewer rows can be in no set. Fewer rows than `least` or an
    empty table give no rules.
    """
    rows = written(
        labelled.where("url IS NOT NULL AND verdict IS NOT NULL").select(
            F.monotonically_increasing_id().alias("row"), tokens(F.col("url")).alias("tokens"), "verdict"
        ),
        "labelled",
    )
    classes = written(_classes(rows, least), "tokens")
    n = rows.count()
    label = F.concat(F.lit(_LABEL), "verdict")
    named = (
        rows.select("row", "verdict", F.explode_outer("tokens").alias("token"))
        .join(classes.select("token", "rep"), "token", "left")
        .groupBy("row", "verdict")
        .agg(F.array_sort(F.collect_set("rep")).alias("items"))
        .select(F.array_append("items", label).alias("items"))
    )
    model = FPGrowth(
        itemsCol="items", minSupport=min(1.0, least / max(n, 1)), minConfidence=confidence
    ).fit(named)
    label = F.get("consequent", F.lit(0))
    found = (
        model.associationRules.where(label.startswith(_LABEL))
        .where(~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
        .select(
            F.array_sort("antecedent").alias("items"),
            F.substring(label, len(_LABEL) + 1, 1 << 30).alias("verdict"),
            "confidence",
            "support",
        )
    )
    reps = classes.where("token = rep").select("token", "alike", "freq")
    anchored = written(
        found.select("*", F.explode("items").alias("token"))
        .join(reps, "token")
        .groupBy("items", "verdict", "confidence", "support")
        .agg(
            F.min_by("token", F.struct("freq", "token")).alias("anchor"),
            F.array_sort(F.collect_list("alike")).alias("needs"),
        ),
        "rules",
    )
    part = anchored.select(
        F.col("anchor").alias("token"),
        F.col("items").alias("part"),
        F.col("verdict").alias("part_verdict"),
        F.col("confidence").alias("part_confidence"),
    )
    needless = (
        anchored.select("items", "verdict", "confidence", F.explode("items").alias("token"))
        .join(part, "token")
        .where("verdict = part_verdict AND part_confidence >= confidence")
        .where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0))
        .select("items", "verdict")
        .distinct()
    )
    return anchored.join(needless, ["items", "verdict"], "left_anti")


def judge(pages: DataFrame, mined: DataFrame, rules=LIST, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every page (page_id, url).

    The longest rule of the list that fits decides. Other pages look up their tokens in the index of
    mined rules: those whose whole set the URL has apply, and the most confident decides, then the
    one with more support, then the larger set. Without any the verdict is the default.

    A null URL and one without :// have an empty host and path and fit no rule of the list. Repeated
    rows and null ids are judged row by row; URLs are taken whole; other columns are left out. An empty
    table gives no rows. The index goes to every task if it is counted small, else it is joined by
    token; the matches of a page meet again under the page's row.
    """
    url = F.col("url").cast("string")
    cut = pages.select(
        F.monotonically_increasing_id().alias("row"), "page_id",
        url.alias("url"), host(url).alias("host"), path(url).alias("path"),
    )
    host_, path_ = F.col("host"), F.col("path")
    ruled = cut.withColumns(
        {
            "rule": _cases(host_, path_, rules, lambda v, r: F.lit(r)),
            "listed": _cases(host_, path_, rules, lambda v, r: F.lit(v)),
        }
    )
    asked = F.when(F.col("rule").isNull() & F.col("url").isNotNull(), tokens(F.col("url")))
    best = F.struct("confidence", "support", F.size("items").alias("n"), "verdict").alias("best")
    mined = written(mined, "index")
    own = F.filter("needs", lambda alike: F.array_contains(alike, F.col("anchor")))
    index = mined.select(F.explode(F.flatten(own)).alias("anchor"), "needs", best)
    if mined.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    looked = (
        ruled.withColumn("tokens", asked)
        .withColumn("anchor", F.explode_outer("tokens"))
        .join(index, "anchor", "left")
        .withColumn("fits", F.forall("needs", lambda alike: F.arrays_overlap(alike, F.col("tokens"))))
    )
    kept = ["page_id", "host", "path", "rule", "listed"]
    return (
        looked.groupBy("row")
        .agg(
            *[F.first(c).alias(c) for c in kept],
            F.max(F.when(F.col("fits"), F.col("best"))).alias("best"),
        )
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("listed", "best.verdict", F.lit(default)).alias("verdict"),
            F.col("best.confidence").alias("confidence"),
        )
    )


def labelled_pages(pages: DataFrame, labels: DataFrame, rules=LIST) -> DataFrame:
    """(url, verdict): the pages that the list leaves open, by their label (page_id is its doc_id).

    Of low quality or toxic means block. Several labels of a page block if one does. Pages that the
    list decides would only teach its own rules.
    """
    url = F.col("url").cast("string")
    listed = _cases(host(url), path(url), rules, lambda v, r: F.lit(v))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad")
    )
    open_ = pages.where(listed.isNull()).select("page_id", url.alias("url"))
    return open_.join(marks, "page_id").select("url", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
