"""URL filters: a blocked Bloom filter of listed URLs and rules in front of an exact join.

A list holds canonical URLs to block, and rules (host, path, allow or block).  Both are keys of one table.  Each URL has a few
candidate keys: its canonical form, and each end of its host with each beginning of its path that a rule could have.  Keys
that the filter passes are joined with the table, which removes false positives; so results don't depend on the filter's size.

The filter has blocks of eight 64-bit words, and a key sets one bit in each word of its block.  It takes ``BITS`` bits a key up to
``MOST_BLOCKS`` blocks of 64 bytes, a proven bound for its broadcast; longer lists only make more false positives.

Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: then up to '?', '#' or the end.  A rule fits its host and
all subdomains where the path starts with the rule's; the longest rule wins, of equally long ones that of the longer host, of
the same key a blocking one.  Without a rule, a URL whose canonical form is listed is blocked and any other one allowed.

Defined results: a null URL, or one without '://', has empty host and path, no rule, and is allowed; ids are passed through, null too; repeated rows
give repeated results; empty tables give empty results (an empty list allows all); null rules and null listed URLs are left out; other columns aren't read.  Only built-in SQL functions run.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraj.llm.common import read, stage

BITS, MOST_BLOCKS = 16, 2**18
WORDS = 8

#: The rules of the query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words between dots and hyphens of a host whose pages the query lists.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")
#: Parameters that don't tell pages apart.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"

_URL = "(?s)^.*?://([^/?#]*)([^?#]*)(?:[?]([^#]*))?"


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, _URL, 2)


def canonical(url: Column) -> Column:
    """Host without user, default port and a leading www. or m., path without doubled and closing slashes, sorted parameters without tracking; no fragment.  Null where there is no '://'."""
    host, path = host_path(url)
    host = F.regexp_replace(F.regexp_replace(host, "^.*@|:(80|443)?$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(url.cast("string"), _URL, 3), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(F.instr(url.cast("string"), "://") > 0, F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def entries_of(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """The table of keys: one row per key, with the rule's text (null for a listed URL), its length, its host's length, and the verdict.  ``rules``: verdict, host, path; ``listed``: url."""
    host = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    ruled = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy(F.concat(F.lit("r"), host, "path").alias("key"), F.concat(host, "path").alias("rule")).agg(F.max(F.struct(F.length(host).alias("host_length"), F.col("verdict"))).alias("x"))
    ruled = ruled.select("key", "rule", F.length("rule").alias("length"), F.col("x.host_length").alias("host_length"), F.col("x.verdict").alias("verdict"))
    urls = listed.select(F.concat(F.lit("u"), canonical(F.col("url"))).alias("key")).where("key IS NOT NULL").distinct()
    return ruled.unionByName(urls.select("key", F.lit(None).cast("string").alias("rule"), F.lit(-1).alias("length"), F.lit(-1).alias("host_length"), F.lit("block").alias("verdict")))


def _hashes(key: str) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.col(key), F.lit(1))


def blocked_bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter of column ``key``: block, words; only blocks that have a bit."""
    h, g = _hashes("key")
    d = keys.select(F.pmod(h, F.lit(n_blocks)).alias("block"), g.alias("g"))
    bits = [F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(g, {6 * w}) & 63 AS int))")) for w in range(WORDS)]
    return d.groupBy("block").agg(F.array(*bits).alias("words"))


def passing(candidates: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """The rows whose ``key`` may be in the filter."""
    h, g = _hashes("key")
    d = candidates.withColumns({"_block": F.pmod(h, F.lit(n_blocks)), "_g": g})
    d = d.join(F.broadcast(bloom.withColumnRenamed("block", "_block")), "_block")
    for w in range(WORDS):
        d = d.where(f"shiftrightunsigned(words[{w}], CAST(shiftrightunsigned(_g, {6 * w}) & 63 AS int)) & 1 = 1")
    return d.drop("_block", "_g", "words")


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed (whether the canonical URL is on the list).  See the module's docstring for edge cases."""
    entries = stage(entries_of(rules, listed), "url-entries")
    # What rules look like bounds the candidates of a URL: labels of their hosts, and the lengths of their paths.
    shape = entries.where("rule IS NOT NULL").agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("rule") - F.col("host_length"))).alias("lengths")).first()
    n_blocks = max(1, min(most_blocks, -(-entries.count() * BITS // (64 * WORDS))))
    url = F.col("url")
    host, path = host_path(url)
    d = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    d = d.select("rid", "page_id", host.alias("host"), path.alias("path"), canonical(url).alias("canonical"))
    d = stage(d, "url-pages")  # row numbers hold from here on
    labels, lengths = shape.labels or 0, ", ".join(map(str, shape.lengths)) or "-1"
    ends = f"transform(filter(sequence(1, {labels}), n -> n <= size(split(host, '[.]'))), n -> substring_index(host, '.', -n))" if labels else "CAST(array() AS array<string>)"
    heads = f"transform(filter(array({lengths}), n -> n BETWEEN 0 AND length(path)), n -> left(path, n))"
    keys = f"flatten(transform({ends}, e -> transform({heads}, p -> concat('r', e, p))))"
    candidates = d.select("rid", F.explode(F.expr(f"concat({keys}, CASE WHEN canonical IS NULL THEN array() ELSE array(concat('u', canonical)) END)")).alias("key"))
    hits = passing(candidates, blocked_bloom(entries, n_blocks), n_blocks)
    best = F.struct("length", "host_length", "verdict", "rule")
    judged = hits.join(entries, "key").groupBy("rid").agg(F.max(best).alias("best"), F.bool_or(F.col("rule").isNull()).alias("listed"))
    return d.join(judged, "rid", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))


def suspicious(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """URLs of hosts that have a listed word."""
    return pages.select(F.col(url_col).alias("url")).where(host_path(F.col("url"))[0].rlike(f"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"))


def op11_url_filter(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return url_filter(pages, spark.createDataFrame(list(RULES), "verdict string, host string, path string"), suspicious(pages))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT rid, page_id, url, translate(regexp_extract(url, '{_URL}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(url, '{_URL}', 2) AS path,
        list_sort(list_filter(string_split(regexp_extract(url, '{_URL}', 3), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS query FROM u),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^.*@|:(80|443)?$', '', 'g'), '^(www|m)\.', '') ||
        regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical FROM h),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)') AND canonical IS NOT NULL),
r AS (SELECT rid, arg_max(verdict, length(rule_host || rule_path)) AS verdict, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule
      FROM c JOIN (VALUES {_VALUES}) AS v(verdict, rule_host, rule_path) ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN r USING (rid) LEFT JOIN l ON c.canonical = l.canonical
"""

QUERIES = {"op11_url_filter": op11_url_filter}
ORACLES = {"op11_url_filter": ORACLE}
