"""Each operator over its whole table, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    config_packing,
    decontaminate,
    lang_id,
    lm_score,
    near_dup,
    packing,
    prefix_trie,
    quality_gam,
    quality_rules,
    structure_repair,
    url_rules,
    warc_revisit,
    wavelet,
)
from plumbline.llm.quality_rules import STOP_WORDS
from plumbline.llm.shared import LOWER, UPPER, remainder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


WORDS = "[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> '']"

_RULES_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10))
          IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
  FROM documents
),
places AS (SELECT doc_id, unnest(words) AS a, unnest(range(len(words))) AS i FROM d),
windows AS (
  SELECT doc_id, i, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c
  FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
found AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
  FROM windows WHERE c IS NOT NULL
),
again AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM found, (SELECT unnest([0, 1, 2]) AS k) WHERE times >= 2 GROUP BY doc_id
),
counts AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(len(array_to_string(words, '')), 0) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         len([w FOR w IN words IF translate(w, '{UPPER}', '{LOWER}') IN {tuple(STOP_WORDS)}])
           AS n_stop_words,
         len([w FOR w IN words IF suffix(w, '!!') OR suffix(w, '??')]) AS n_shouts,
         len([x FOR x IN lines IF trim(x, ' ')[1] IN ('-', '*', '•')]) AS n_bullet_lines,
         len([x FOR x IN lines IF suffix(trim(x, ' '), '...') OR suffix(trim(x, ' '), '…')])
           AS n_open_lines
  FROM d LEFT JOIN again USING (doc_id)
)
SELECT *, {quality_rules.BASE_FAILED} AS base_failed, {quality_rules.verdict_sql()} AS kept
FROM counts
"""


@query("op1_quality_rules", _RULES_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its token-frequency and lattice log10 probabilities."""
    return lm_score.score(table(spark, sf_dir, "documents"))


_TRACKED = ", ".join(f"'{k}'" for k in warc_revisit.TRACKING)

_REVISIT_SQL = f"""
WITH bare AS (
  SELECT page_id, md5(html) AS tag, regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^.*?://', '', 's') AS rest
  FROM pages
),
pages2 AS (
  SELECT page_id, tag,
         regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\\.|:(?:80|443)$', '', 'g')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
         || coalesce('?' || nullif(array_to_string(list_sort([
              k FOR k IN string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&')
              IF k <> '' AND string_split(k, '=')[1] NOT IN ({_TRACKED})]), '&'), ''), '') AS canonical
  FROM bare
),
response AS (
  SELECT 2 * page_id AS source_id, canonical, 16 * page_id AS source_time, page_id, tag FROM pages2
),
revisit AS (
  SELECT 2 * page_id + 1 AS record_id, canonical, page_id,
         CASE WHEN page_id % 11 = 0 THEN 16 * page_id - 5 ELSE 16 * page_id + 643 END AS time,
         CASE page_id % 7 WHEN 1 THEN 'stale' WHEN 2 THEN NULL ELSE tag END AS seen,
         CASE WHEN page_id % 7 = 0 THEN 'W/' ELSE '' END AS weak
  FROM pages2
),
m AS (
  SELECT r.*, s.source_id, s.source_time, s.tag AS held,
         CASE WHEN s.source_id IS NULL THEN 'missing' WHEN r.seen IS NULL THEN 'unchecked'
              WHEN r.seen = s.tag THEN 'resolved' ELSE 'mismatch' END AS status
  FROM revisit r ASOF LEFT JOIN response s
    ON r.canonical = s.canonical AND r.time > s.source_time
)
SELECT record_id, canonical, time, coalesce(source_id, -1) AS source_id,
       coalesce(source_time, -1) AS source_time, status,
       CASE WHEN status IN ('resolved', 'unchecked') THEN held END AS digest,
       CASE WHEN status IN ('resolved', 'unchecked') THEN
         'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10)
         || 'date: ' || (page_id + 40) || chr(10)
         || 'etag: ' || CASE WHEN seen IS NULL THEN '' ELSE weak END || '"' || held || '"' END AS headers
FROM m
"""


@query("op3_warc_revisit", _REVISIT_SQL)
def op3_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified revisit of the pages with the response it stands for."""
    records = warc_revisit.records_of_pages(table(spark, sf_dir, "pages"))
    lines = F.transform(
        F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit(": "), x["value"])
    )
    found = warc_revisit.resolve(records).withColumn("headers", F.array_join(lines, "\n"))
    none = {c: F.coalesce(c, F.lit(-1)).cast("long") for c in ("source_id", "source_time")}
    return found.withColumns(none)


@query("op4_url_rules")
def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rule of the list that fits, and the verdict."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = url_rules.mine(url_rules.labelled_pages(pages, table(spark, sf_dir, "labels")))
    return url_rules.judge(pages, mined)


_ITEM_WORDS = (
    "[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), '{0}', '{1}'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF x <> '']"
).format(UPPER, LOWER)

_DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[s + 1:s + l], ' ') AS win
  FROM (SELECT *, unnest(range(0, len(w) - l + 1)) AS s
        FROM (SELECT *, least(len(w), 10) AS l FROM b WHERE len(w) > 0))
),
dw AS (
  SELECT doc_id, l, s, array_to_string(w[s + 1:s + l], ' ') AS win
  FROM (SELECT *, unnest(range(0, len(w) - l + 1)) AS s
        FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)
),
m AS (SELECT doc_id, dw.l, s, item_id FROM dw JOIN iw ON dw.l = iw.l AND dw.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT s + k) AS n
        FROM (SELECT doc_id, s, unnest(range(0, l)) AS k FROM m) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items,
       sha256(coalesce(ids.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op5_decontamination", _DECONTAMINATION_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words and items that benchmark windows hit."""
    found = decontaminate.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op6_lang_id")
def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    found = lang_id.identify(docs, lang_id.train(docs))
    return found.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


@query("op7_wavelet_tokens")
def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and tokens, read back from the shards' files."""
    return wavelet.token_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op8_near_dup")
def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest document that near-duplicate links lead to."""
    return near_dup.link(table(spark, sf_dir, "documents"))


@query("op9_quality_gam")
def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score; learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.classify(docs, model, carry=["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, packed into sequences of 1024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op11_best_fit")
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, in as few sequences of 2048 tokens as the plan finds."""
    pieces = config_packing.cut(table(spark, sf_dir, "documents"))
    return config_packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


# CRC-32 of a short ASCII text, as SQL has none: crc_table holds its 256 words, crc(x) uses them.
_CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7],
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS words
)"""


def _crc(text: str) -> str:
    return f"""xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS BIGINT))),
        lambda c, b: xor(c >> 8, words[(xor(c, b) & 255) + 1])))"""


_TRIE_SQL = f"""
WITH {_CRC_TABLE},
lists AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}}
           ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
headed AS (SELECT conv_id, l, {_crc("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM lists, crc_table),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l
  FROM headed a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 100
),
prefixes AS (
  SELECT conv_id, d, l[1:d] AS k, d = len(l) AS ends, CASE WHEN d = 0 THEN 0 ELSE length(l[d].x) END AS c
  FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)
),
nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(c) AS c,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY k, d
),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (k)),
sums AS (
  SELECT k[1:a] AS k, sum((n_convs - 1) * c) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own) GROUP BY ALL
)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN sums USING (k) LEFT JOIN own p ON p.d = o.d - 1 AND p.k = o.k[1:o.d - 1]
"""


@query("op12_prefix_trie", _TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn prefix of the conversations, after they take over shared heads."""
    lists = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_heads(lists))


_STRUCTURE_SQL = f"""
WITH {_CRC_TABLE},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
  FROM conversations, crc_table
),
rows_ AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE fault <> 0
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS empty,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM rows_)
),
faults AS (
  SELECT *, empty AS is_blank, again AND NOT empty AS is_again, cut AND NOT again AND NOT empty AS is_cut,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair
  FROM numbered
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_again) AS duplicate,
         count(*) FILTER (is_cut) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'gone': is_blank OR is_again, 'extra': CASE WHEN is_cut THEN 3 ELSE 0 END, 'i': role[1],
               'line': role || ':' || text, 'text': text, 'st': [{{'c': 0, 't': '', 'x': ''}}]}} ORDER BY n) AS l
  FROM faults GROUP BY conv_id
),
-- Cheapest edits so far that have made nothing, s, ..u and ..a; x are the repaired lines.
folded AS (
  SELECT *, list_reduce(l, lambda acc, e: {{'gone': e.gone, 'extra': e.extra, 'i': e.i, 'line': e.line, 'text': e.text,
    'st': list_transform([list_concat(acc.st, [
        list_min([acc.st[3],
          {{'c': acc.st[1].c + 3, 't': acc.st[1].t || 'I', 'x': acc.st[1].x || 'user:'}},
          {{'c': acc.st[2].c + 3, 't': acc.st[2].t || 'I', 'x': acc.st[2].x || chr(10) || 'user:'}},
          {{'c': acc.st[4].c + 3, 't': acc.st[4].t || 'I', 'x': acc.st[4].x || chr(10) || 'user:'}}]),
        list_min([acc.st[4],
          {{'c': acc.st[3].c + 3, 't': acc.st[3].t || 'I', 'x': acc.st[3].x || chr(10) || 'assistant:'}},
          {{'c': acc.st[1].c + 6, 't': acc.st[1].t || 'II', 'x': acc.st[1].x || 'user:' || chr(10) || 'assistant:'}},
          {{'c': acc.st[2].c + 6, 't': acc.st[2].t || 'II',
            'x': acc.st[2].x || chr(10) || 'user:' || chr(10) || 'assistant:'}}])])],
      lambda b: [
        {{'c': b[1].c + 4, 't': b[1].t || 'D', 'x': b[1].x}},
        list_min([{{'c': b[2].c + 4, 't': b[2].t || 'D', 'x': b[2].x}},
          {{'c': b[1].c + CASE WHEN e.gone OR e.i <> 's' THEN 1000000 ELSE e.extra END,
            't': b[1].t || 'K', 'x': b[1].x || e.line}}]),
        list_min([{{'c': b[5].c + 4, 't': b[5].t || 'D', 'x': b[5].x}},
          {{'c': b[1].c + CASE WHEN e.gone THEN 1000000 WHEN e.i = 'u' THEN e.extra ELSE e.extra + 3 END,
            't': b[1].t || CASE WHEN e.i = 'u' THEN 'K' ELSE 'R' END,
            'x': b[1].x || CASE WHEN e.i = 'u' THEN e.line ELSE 'user:' || e.text END}},
          {{'c': b[2].c + CASE WHEN e.gone THEN 1000000 WHEN e.i = 'u' THEN e.extra ELSE e.extra + 3 END,
            't': b[2].t || CASE WHEN e.i = 'u' THEN 'K' ELSE 'R' END,
            'x': b[2].x || chr(10) || CASE WHEN e.i = 'u' THEN e.line ELSE 'user:' || e.text END}},
          {{'c': b[6].c + CASE WHEN e.gone THEN 1000000 WHEN e.i = 'u' THEN e.extra ELSE e.extra + 3 END,
            't': b[6].t || CASE WHEN e.i = 'u' THEN 'K' ELSE 'R' END,
            'x': b[6].x || chr(10) || CASE WHEN e.i = 'u' THEN e.line ELSE 'user:' || e.text END}}]),
        list_min([{{'c': b[6].c + 4, 't': b[6].t || 'D', 'x': b[6].x}},
          {{'c': b[5].c + CASE WHEN e.gone THEN 1000000 WHEN e.i = 'a' THEN e.extra ELSE e.extra + 3 END,
            't': b[5].t || CASE WHEN e.i = 'a' THEN 'K' ELSE 'R' END,
            'x': b[5].x || chr(10) || CASE WHEN e.i = 'a' THEN e.line ELSE 'assistant:' || e.text END}}])]
    )[1]}},
    {{'gone': false, 'extra': 0, 'i': '', 'line': '', 'text': '', 'st': [
      {{'c': 0, 't': '', 'x': ''}}, {{'c': 1000000, 't': '', 'x': ''}},
      {{'c': 1000000, 't': '', 'x': ''}}, {{'c': 1000000, 't': '', 'x': ''}}]}}).st AS st
  FROM counts
),
best AS (
  SELECT *, list_min([st[1], st[4],
           {{'c': st[3].c + 3, 't': st[3].t || 'I', 'x': st[3].x || chr(10) || 'assistant:'}},
           {{'c': st[2].c + 6, 't': st[2].t || 'II', 'x': st[2].x || chr(10) || 'user:' || chr(10) || 'assistant:'}}]) AS b
  FROM folded
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.t, '') AS audit, sha256(coalesce(b.x, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""


@query("op13_structure_repair", _STRUCTURE_SQL)
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, and its cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    turns = structure_repair.damaged(conversations)
    audits = written(structure_repair.audit(turns), "audits")
    repaired = audits.join(structure_repair.digests(turns, audits).withColumnRenamed("conv_id", "_id"),
                           F.col("conv_id").eqNullSafe(F.col("_id")))
    ids = conversations.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(repaired, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_conv").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
