"""URL lists with dates: every capture is judged by the entries in force when it was fetched.

A list's history is a table of dated entries, each adding or removing a host or a URL prefix. Entries become
validity intervals (an addition holds until the next entry for the same list and value), and an as-of join
matches each capture's host suffixes and path prefixes, as deep as the deepest entry, with the intervals that hold its time of fetching.
Captures are salted, so that a host with most of the captures is spread over many tasks; the far smaller
intervals are repeated for each salt.

Results at the edges: dots at a host's end don't count; a bracketed address is a host of its own; a null or malformed URL, or a null time, matches nothing and is not blocked; of two
entries of the same list, value and day a removal wins; repeated entries count once; each capture row gives
one result row even if its id repeats; empty captures give an empty result, empty lists block nothing; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravelake.llm.common import table

SALTS = 16
#: Host of a URL, a bracketed address as it is, without the dots that may end it.
_HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\x5B[^\x5D/?#]*\x5D|[^/?#:\x5B]+)"
_HOST_SQL = "regexp_replace(lower(regexp_extract({u}, '" + _HOST_PATTERN + "', 1)), '[.]+$', '')"
_HOST = _HOST_SQL.replace("\\", "\\\\")  # a backslash in a string of Spark SQL is written twice
_PATH = r"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def with_intervals(entries: DataFrame) -> DataFrame:
    """entries (list, value, action 'add' or 'remove', since date) -> list, value, from, until (exclusive, null if open)."""
    last = entries.groupBy("list", "value", "since").agg(F.max("action").alias("action"))  # 'remove' sorts after 'add'
    until = F.lead("since").over(W.partitionBy("list", "value").orderBy("since"))
    return last.withColumn("until", until).filter("action = 'add'").select("list", "value", F.col("since").alias("from"), "until")


def match_keys(url: str, deepest: str) -> str:
    """SQL for the list values that can match a URL: its host, the host's parents of two labels and more, and prefixes of up to `deepest` path segments."""
    host = _HOST.format(u=url)
    path = _PATH.format(u=url)
    suffixes = "transform(sequence(1, greatest(size(l) - 1, 1)), i -> array_join(slice(l, i, size(l)), '.'))"
    prefixes = f"transform(sequence(1, greatest(least(size(p), {deepest}), 1)), i -> if(size(p) >= i, concat(h, '/', array_join(slice(p, 1, i), '/')), null))"
    segments = f"filter(split({path}, '/'), s -> s <> '')"
    inner = f"transform(array(split(h, '[.]')), l -> transform(array({segments}), p -> array_compact(array_distinct(concat({suffixes}, {prefixes}))))[0])[0]"
    return f"if(coalesce({host}, '') = '', cast(array() AS array<string>), transform(array({host}), h -> {inner})[0])"


def url_filter(captures: DataFrame, entries: DataFrame, key: str, url: str, fetched: str, salts: int = SALTS) -> DataFrame:
    """key, host, fetched, blocked, n_entries and the most specific matching entry (longest value, then list) of each capture."""
    c = captures.select(F.col(key), F.expr(_HOST.format(u=f"`{url}`")).alias("host"), F.col(fetched).alias("fetched"), F.col(url).alias("__u"))
    deepest = entries.agg(F.coalesce(F.max(F.size(F.split("value", "/")) - 1), F.lit(0)).alias("__deepest"))  # no prefix of more segments is listed
    c = c.withColumn("__row", F.monotonically_increasing_id()).crossJoin(F.broadcast(deepest))
    c = c.withColumn("__keys", F.expr(match_keys("__u", "__deepest"))).drop("__u", "__deepest")
    c = c.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)))
    spans = with_intervals(entries).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    wide = c.withColumn("__key", F.explode_outer("__keys")).drop("__keys")
    at = (wide["__key"] == spans["value"]) & (wide["__salt"] == spans["__s"]) & (wide["fetched"] >= spans["from"]) & (spans["until"].isNull() | (wide["fetched"] < spans["until"]))
    joined = wide.join(spans, at, "left")
    best = F.max(F.when(F.col("value").isNotNull(), F.struct(F.length("value").alias("n"), F.col("value").alias("value"), F.col("list").alias("list"))))
    out = joined.groupBy("__row", key, "host", "fetched").agg(F.count("value").alias("n_entries"), best.alias("b"))
    return out.select(key, F.nullif("host", F.lit("")).alias("host"), "fetched", (F.col("n_entries") > 0).alias("blocked"), "n_entries", F.col("b.value").alias("entry"), F.col("b.list").alias("list"))


#: The tables hold no lists and no times: a day comes from the page id, and dated entries from digests of the hosts seen.
_DAY = "date_add(date '2024-01-01', cast(page_id * 37 % 366 AS int))"


def entries_of(pages: DataFrame) -> DataFrame:
    """Two synthetic lists over the hosts, first path segments and whole paths of the pages: about a third of values are added, some removed and added again."""
    p = pages.select(F.expr(_HOST.format(u="url")).alias("h"), F.expr(f"filter(split({_PATH.format(u='url')}, '/'), s -> s <> '')").alias("s"))
    values = p.select(F.explode(F.expr("if(size(s) > 0, array(h, concat(h, '/', s[0]), concat(h, '/', array_join(s, '/'))), array(h))")).alias("value")).filter("value <> ''").distinct()
    digit = "cast(conv(substring(md5(cast(value AS binary)), {i}, 4), 16, 10) AS int)"
    v = values.select("value", F.expr(digit.format(i=1)).alias("a"), F.expr(digit.format(i=5)).alias("b"))
    v = v.filter("a % 3 = 0").withColumn("list", F.expr("if(b % 2 = 0, 'ads', 'malware')"))
    steps = "array(named_struct('action', 'add', 'd', b % 200), named_struct('action', if(a % 2 = 0, 'remove', 'add'), 'd', b % 200 + 60), named_struct('action', 'add', 'd', b % 200 + 120))"
    return v.withColumn("e", F.explode(F.expr(steps))).select("list", "value", F.col("e.action").alias("action"), F.expr("date_add(date '2024-01-01', e.d)").alias("since"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched", F.expr(_DAY))
    out = url_filter(pages, entries_of(pages), "page_id", "url", "fetched")
    return out.withColumn("fetched", F.col("fetched").cast("string"))


def oracle() -> str:
    host = _HOST_SQL.format(u="url")
    path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return f"""
WITH c AS (SELECT page_id, {host} AS host, list_filter(string_split({path}, '/'), lambda s: s <> '') AS segs, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS DATE) AS fetched FROM pages),
values_ AS (SELECT DISTINCT value FROM (SELECT host AS value FROM c UNION ALL SELECT host || '/' || segs[1] FROM c WHERE len(segs) > 0 UNION ALL SELECT host || '/' || array_to_string(segs, '/') FROM c WHERE len(segs) > 0) WHERE value <> ''),
digits AS (SELECT value, CAST('0x' || substr(md5(value), 1, 4) AS INT) AS a, CAST('0x' || substr(md5(value), 5, 4) AS INT) AS b FROM values_),
listed AS (SELECT *, CASE WHEN b % 2 = 0 THEN 'ads' ELSE 'malware' END AS list FROM digits WHERE a % 3 = 0),
entries AS (SELECT list, value, 'add' AS action, b % 200 AS d FROM listed UNION ALL SELECT list, value, CASE WHEN a % 2 = 0 THEN 'remove' ELSE 'add' END, b % 200 + 60 FROM listed UNION ALL SELECT list, value, 'add', b % 200 + 120 FROM listed),
dated AS (SELECT list, value, CAST(DATE '2024-01-01' + d AS DATE) AS since, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, value ORDER BY since) AS until FROM dated) WHERE action = 'add'),
keys AS (SELECT page_id, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(segs) + 1), lambda i: host || '/' || array_to_string(segs[:i], '/'))))) AS k FROM c WHERE host <> ''),
hits AS (SELECT page_id, value, list FROM keys JOIN spans ON k = value AND fetched >= since AND (until IS NULL OR fetched < until)),
best AS (SELECT page_id, count(*) AS n_entries, max({{'n': length(value), 'value': value, 'list': list}}) AS b FROM hits GROUP BY page_id)
SELECT page_id, nullif(host, '') AS host, CAST(fetched AS VARCHAR) AS fetched, coalesce(n_entries, 0) > 0 AS blocked, coalesce(n_entries, 0) AS n_entries, b.value AS entry, b.list AS list FROM c LEFT JOIN best USING (page_id)"""
