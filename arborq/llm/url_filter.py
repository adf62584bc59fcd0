"""URL filter: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter has blocks of 512 bits; a URL's hash names one block and one bit in each of its eight 64-bit words.
It is built by aggregation (bitwise or of each block's words), is never larger than
``MAX_BLOCKS`` blocks whatever the list's length, and so is safe to broadcast. URLs that pass it
are checked by an exact join with the list, which removes false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import hot_keys, materialise, replicate, spread, table

#: 64 bytes each: a filter holds 4 MB at most. A longer list only lets more URLs through to the exact join.
MAX_BLOCKS = 1 << 16
BITS_PER_URL = 16

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the query's rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The query's list: canonical URLs of ``pages`` whose host has one of these labels, and of pages that only repeat an
#: article which a page of a smaller id holds.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def host_of(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/ ? #`` or the end, lower-cased in A-Z; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, path without closing slashes; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    h = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(8)]


def blocked_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0 .. w7)`` of ``listed(url)``: at most ``blocks`` rows."""
    return listed.groupBy(_block(F.col("url"), blocks).alias("block")).agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("url")))])


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` of every row of ``pages``.

    A rule ``(verdict, host, path)`` fits its host and all subdomains where the URL's path starts with the
    rule's; the longest (host and path together) wins, the first given among equals. URLs without a rule are blocked if their
    canonical form is in ``listed(url)``, else allowed. Null URLs and those without ``://`` have an
    empty host and path, no rule, and are allowed. Null and repeated ids are carried; other columns are ignored."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    rows = rows.withColumns({"rule": rule if rule is not None else F.lit(None).cast("string"), "ruled": verdict if verdict is not None else F.lit(None).cast("string"), "canon": canonical(F.col("host"), F.col("path"))})

    listed = materialise(listed.where("url IS NOT NULL AND url <> ''").select("url").distinct(), "listed")
    blocks = max(1, min(MAX_BLOCKS, -(-listed.count() * BITS_PER_URL // 512)))
    bloom = blocked_bloom(listed, blocks)
    probed = rows.withColumn("block", _block(F.col("canon"), blocks)).join(F.broadcast(bloom), "block", "left")
    passes = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canon"))):
        passes = passes & F.coalesce(F.col(f"w{i}").bitwiseAND(bit) != 0, F.lit(False))
    probed = probed.select("id", "host", "path", "rule", "ruled", "canon", (F.col("ruled").isNull() & passes).alias("possible"))
    clear = probed.where("NOT possible").select("id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    # the list's side holds each URL once, so a URL that many pages share multiplies nothing; Spark splits its rows at run time
    hits = probed.where("possible").join(listed.withColumn("hit", F.lit("block")), F.col("canon") == F.col("url"), "left")
    return clear.union(hits.select("id", "host", "path", "rule", F.coalesce("hit", F.lit("allow")))).withColumnRenamed("id", id_col)


def copied_pages(pages: DataFrame) -> DataFrame:
    """``(url)``: canonical URLs of the pages whose article (what stands between ``<article>`` and the last ``</article>``)
    a page of a smaller id holds too. Articles are compared by a 128-bit digest; one that very many pages hold is dealt over several tasks."""
    article = F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.where("page_id IS NOT NULL").select("page_id", canonical(host, path).alias("url"), article.alias("article"))
    rows = rows.where("article <> ''").select("page_id", "url", F.md5("article").alias("article"))
    first = rows.groupBy("article").agg(F.count("*").alias("held"), F.min("page_id").alias("first")).where("held > 1")
    hot = hot_keys(first, "article", "held")
    met = spread(rows, hot, "article", "page_id").join(replicate(first.select("article", "first"), hot, "article"), ["article", "salt"])
    return met.where("page_id > first").select("url")


def listed_pages(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    own = pages.where(F.arrays_overlap(F.split(host, r"\."), F.lit(LISTED_LABELS)))
    return own.select(canonical(host, path_of(F.col("url"))).alias("url")).union(copied_pages(pages))


def op5_url_filter(spark, sf_dir):
    """Verdicts of all ``pages``."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, listed_pages(pages))


OP5_SQL = rf"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UP}', '{_LOW}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         nullif(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') AS article
  FROM pages
), c AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canon FROM p
), listed AS (
  SELECT DISTINCT canon FROM c
  WHERE canon <> '' AND (list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in LISTED_LABELS)}])
    OR page_id > (SELECT min(d.page_id) FROM p d WHERE d.article = c.article))
), r AS (
  SELECT page_id, host, path, canon,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM c
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
