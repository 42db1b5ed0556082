"""Not-modified revisits of web archives: resolved to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import ascii_lower

# Headers that a not-modified answer may renew; the others stay those of the full response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query keys that name a visit and not a document.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid")
# Records of a URL that fall into the same stretch of time are ordered in one group.
STRETCH = 4096

RECORD = (
    "record_id long, kind string, url string, time long, headers map<string,string>, digest string"
)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without http/https, www. and default port; no fragment, no
    tracking keys, other keys in order, no slash at the end."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    rest = F.regexp_replace(bare, "(?s)^.*?://", "")
    host = F.regexp_replace(
        ascii_lower(F.regexp_extract(rest, "(?s)^([^/?]*)", 1)), "^www\\.|:(?:80|443)$", ""
    )
    path = F.regexp_replace(F.regexp_extract(rest, "(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, "(?s)^[^?]*\\?(.*)$", 1), "&")
    keys = F.array_sort(
        F.filter(query, lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    )
    tail = F.when(F.size(keys) > 0, F.concat(F.lit("?"), F.array_join(keys, "&"))).otherwise("")
    return F.concat(host, path, tail)


def resolve(records: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Revisits of `records` (see RECORD) with the response they stand for.

    kind is `response` or `revisit`; header names are in lower case. One row per revisit:
    record_id, canonical, time, source_id and source_time (the latest response of the canonical URL
    that is earlier, the larger record_id if two are of one time), status (`resolved`, `mismatch` if
    a validator of the revisit, etag or last-modified, differs from that of the response, `unchecked`
    if the two have no validator in common, `missing` if there is no earlier response), digest and
    headers (of the response, renewed by the revisit's permitted ones; null unless resolved or
    unchecked). A weak etag (W/) equals the strong one with the same value.

    A URL may hold any share of the records: they are ordered within stretches of time, the last
    response of each stretch is carried to the next one that has revisits, and only these summaries
    of a URL, not its records, meet. Records without url or time can't be matched: such revisits are
    `missing`, such responses are left out. Repeated records are resolved each. Other columns are left
    out. An empty table gives no rows.
    """
    rows = records.select(
        "record_id", "kind", "time", "headers", "digest", canonical_url(F.col("url")).alias("url")
    ).withColumn("stretch", F.floor(F.col("time") / stretch))
    placed = F.col("url").isNotNull() & F.col("time").isNotNull()
    rank = F.struct("time", "record_id")
    payload = F.struct("record_id", "time", "digest", "headers")
    # One row for the responses of a URL and time; the frame below can't tell them apart.
    full = (
        rows.where(placed & (F.col("kind") == "response"))
        .groupBy("url", "stretch", "time")
        .agg(F.max_by(payload, F.struct("record_id", "digest")).alias("full"))
    )
    asked = rows.where("kind = 'revisit'").select(
        "url", "stretch", "time", F.struct("record_id", "headers").alias("asked")
    )
    found = asked.where(placed)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = full.select("url", "stretch", "time", "full", none(found, "asked")).union(
        found.select("url", "stretch", "time", none(full, "full"), "asked")
    )
    inside = Window.partitionBy("url", "stretch").orderBy("time")
    near = F.last("full", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, -1))
    # The last response of each stretch, and the one before each stretch.
    ends = both.groupBy("url", "stretch").agg(
        F.max_by("full", F.when(F.col("full").isNotNull(), F.col("time"))).alias("end")
    )
    order = Window.partitionBy("url").orderBy("stretch")
    before = ends.select(
        F.col("url").alias("u"),
        F.col("stretch").alias("s"),
        F.last("end", ignorenulls=True)
        .over(order.rowsBetween(Window.unboundedPreceding, -1))
        .alias("before"),
    )
    matched = (
        both.withColumn("near", near)
        .where("asked IS NOT NULL")
        .join(before, (F.col("url") == F.col("u")) & (F.col("stretch") == F.col("s")), "left")
        .select("url", "time", "asked", F.coalesce("near", "before").alias("full"))
    )
    lost = asked.where(~placed).select("url", "time", "asked", none(full, "full"))
    return _merged(matched.union(lost))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _merged(matched: DataFrame) -> DataFrame:
    """Check validators and merge headers of pairs (asked, full)."""
    asked = F.coalesce(F.col("asked.headers"), F.create_map().cast("map<string,string>"))
    held = F.coalesce(F.col("full.headers"), F.create_map().cast("map<string,string>"))
    tag, own_tag = _strong(asked["etag"]), _strong(held["etag"])
    date, own_date = asked["last-modified"], held["last-modified"]
    common = (tag.isNotNull() & own_tag.isNotNull()) | (date.isNotNull() & own_date.isNotNull())
    differs = F.coalesce(tag != own_tag, F.lit(False)) | F.coalesce(date != own_date, F.lit(False))
    status = (
        F.when(F.col("full").isNull(), "missing")
        .when(differs, "mismatch")
        .when(common, "resolved")
        .otherwise("unchecked")
    )
    renewed = F.map_filter(asked, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(held, lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    good = F.col("status").isin("resolved", "unchecked")
    return matched.withColumn("status", status).select(
        F.col("asked.record_id").alias("record_id"),
        F.col("url").alias("canonical"),
        "time",
        F.col("full.record_id").alias("source_id"),
        F.col("full.time").alias("source_time"),
        "status",
        F.when(good, F.col("full.digest")).alias("digest"),
        F.when(good, F.map_concat(kept, renewed)).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Records (see RECORD) as a crawl of the pages would leave them: a full response for each page
    and a later not-modified revisit, some with a weak, a stale or no validator, some too early."""
    id_, tag = F.col("page_id"), F.md5(F.col("html").cast("binary"))
    quoted = F.concat(F.lit('"'), tag, F.lit('"'))
    text = lambda **kv: F.map_filter(
        F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v)]),
        lambda k, v: v.isNotNull(),
    )
    turn = F.pmod(id_, F.lit(7))
    seen = (
        F.when(turn == 0, F.concat(F.lit("W/"), quoted))
        .when(turn == 1, F.lit('"stale"'))
        .when(turn != 2, quoted)
    )
    response = pages.select(
        (2 * id_).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        (16 * id_).alias("time"),
        text(etag=quoted, content_type=F.lit("text/html"), date=id_.cast("string")).alias("headers"),
        tag.alias("digest"),
    )
    revisit = pages.select(
        (2 * id_ + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        "url",
        F.when(F.pmod(id_, F.lit(11)) == 0, 16 * id_ - 5).otherwise(16 * id_ + 643).alias("time"),
        text(
            etag=seen, content_type=F.lit("text/plain"), date=(id_ + 40).cast("string"),
            cache_control=F.lit("max-age=60"),
        ).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return response.union(revisit)
