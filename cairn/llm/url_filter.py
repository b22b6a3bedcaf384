"""URL filters by a temporal list join: dated list entries become validity intervals that captures are joined to as of their fetch day.

A list is a log of dated entries; an entry holds from its day until the next entry of the same key. Every capture is
looked up under its exact address, its host and each parent domain: intervals are cut into spans of SPAN days, equality on
key and span joins them, and of the few of a span the one that holds the fetch day stays; of the entries in force the most
specific decides. Captures of a host that holds a third of the table meet the
written, small interval side in an ordinary join, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import read_table, unused, written

ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)"
FOREVER = 2**31 - 1
#: Days in a span: a capture meets at most so many intervals of a key.
SPAN = 16
#: In the query: an entry holds so many days, and comes back after so many.
HELD, AWAY = 90, 200


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ADDRESS, 1))


def address(url: Column) -> Column:
    """Host and path, without scheme, port, query, fragment and final slash."""
    return F.concat(host(url), F.regexp_replace(F.regexp_extract(url, ADDRESS, 2), "/+$", ""))


def lookup_keys(url: Column) -> Column:
    """What a list may name a URL by, most specific first: its address, its host, then the parent domains of two labels or more."""
    labels = F.split(host(url), "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    return F.when(host(url) != "", F.concat(F.array(F.concat(F.lit("u:"), address(url))), parents))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, verdict, since, until) of dated entries (key, day, verdict); the entry is in force on days since <= day < until.

    Of several entries of a key on one day the greatest verdict counts. Entries whose key, day or verdict is null are
    void. A verdict of 'drop' ends an entry and gives no interval. No entries give no intervals.
    """
    daily = entries.where(F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("verdict").isNotNull()).groupBy("key", "day").agg(F.max("verdict").alias("verdict"))
    until = F.coalesce(F.lead("day").over(Window.partitionBy("key").orderBy("day")), F.lit(FOREVER))
    return daily.select("key", "verdict", F.col("day").alias("since"), until.alias("until")).where(F.col("verdict") != "drop")


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, day, ...) with ``verdict``, ``key`` and ``since`` of the entry that decides; null where none is in force.

    URLs that are null or have no host, and null days, match nothing and are kept. Repeated rows get equal results.
    Columns named verdict, key or since are replaced; other columns pass through. An empty list decides nothing.
    """
    captures = captures.drop("verdict", "key", "since")
    names, best_ = captures.columns, unused("best", captures)
    asked = captures.select("url", "day").where(F.col("url").isNotNull() & F.col("day").isNotNull()).distinct()
    asked = asked.select("url", "day", F.posexplode(lookup_keys(F.col("url"))).alias("depth", "key")).withColumn("span", F.floor(F.col("day") / SPAN))
    ends = captures.agg(F.min("day").alias("first"), F.max("day").alias("last"))  # one row
    intervals = written(validity_intervals(entries), "intervals").join(F.broadcast(ends)).where("since <= last AND until > first")
    spans = F.sequence(F.floor(F.greatest("since", "first") / SPAN), F.floor(F.least(F.col("until") - 1, "last") / SPAN))
    spans = intervals.select("key", "verdict", "since", "until", F.explode(spans).alias("span"))
    found = asked.join(spans, ["key", "span"]).where((F.col("since") <= F.col("day")) & (F.col("day") < F.col("until")))
    best = found.groupBy("url", "day").agg(F.min(F.struct("depth", "key", "verdict", "since")).alias(best_))
    out = captures.join(best, ["url", "day"], "left")
    return out.select(*names, *[F.col(f"{best_}.{c}").alias(c) for c in ("verdict", "key", "since")])


def list_of_pages(captures: DataFrame) -> DataFrame:
    """A list in the shape of real ones, derived from the captures: every host is blocked from some days after its first
    capture for HELD days, freed, and blocked again later; a URL captured twice is allowed from its second capture on;
    parent domains are watched from their first capture on."""
    hosts = captures.where(host(F.col("url")) != "").groupBy(host(F.col("url")).alias("h")).agg(F.min("day").alias("first"))
    begin = F.col("first") + F.char_length("h") % 60
    events = F.array(*[F.struct((begin + shift).cast("int").alias("day"), F.lit(verdict).alias("verdict")) for shift, verdict in ((0, "block"), (HELD, "drop"), (AWAY, "block"))])
    blocked = hosts.select(F.concat(F.lit("h:"), "h").alias("key"), F.explode(events).alias("e")).select("key", "e.day", "e.verdict")
    watched = hosts.where(F.size(F.split("h", "[.]")) > 2).groupBy(F.concat(F.lit("h:"), F.expr("substring_index(h, '.', -2)")).alias("key")).agg(F.min("first").cast("int").alias("day")).select("key", "day", F.lit("watch").alias("verdict"))
    days = captures.where(host(F.col("url")) != "").groupBy(address(F.col("url")).alias("a"), "day").count().groupBy("a").agg(F.count("*").alias("n"), F.max("day").alias("day")).where(F.col("n") > 1)
    allowed = days.select(F.concat(F.lit("u:"), "a").alias("key"), F.col("day").cast("int").alias("day"), F.lit("allow").alias("verdict"))
    return blocked.unionByName(watched).unionByName(allowed)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with a fetch day that goes through a year by page_id, judged by the list derived from the pages."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.pmod(F.col("page_id"), F.lit(365)).cast("int").alias("day"))
    return url_filter(pages, list_of_pages(pages)).select("page_id", "day", "verdict", F.col("key").alias("list_key"), "since")


SQL = f"""
WITH caps AS (
  SELECT page_id, url, CAST(page_id % 365 AS INTEGER) AS day,
         lower(regexp_extract(url, '{ADDRESS}', 1)) AS h, regexp_replace(regexp_extract(url, '{ADDRESS}', 2), '/+$', '') AS path
  FROM pages),
hosts AS (SELECT h, min(day) AS first FROM caps WHERE h <> '' GROUP BY h),
ev AS (
  SELECT 'h:' || h AS key, first + CAST(length(h) % 60 AS INTEGER) + shift AS day, verdict
  FROM hosts, (VALUES (0, 'block'), ({HELD}, 'drop'), ({AWAY}, 'block')) s(shift, verdict)
  UNION ALL
  SELECT 'h:' || array_to_string(string_split(h, '.')[-2:], '.'), min(first), 'watch' FROM hosts WHERE len(string_split(h, '.')) > 2 GROUP BY 1
  UNION ALL
  SELECT 'u:' || h || path, max(day), 'allow' FROM caps WHERE h <> '' GROUP BY 1 HAVING count(DISTINCT day) > 1),
daily AS (SELECT key, day, max(verdict) AS verdict FROM ev GROUP BY key, day),
iv AS (SELECT key, verdict, day AS since, lead(day, 1, {FOREVER}) OVER (PARTITION BY key ORDER BY day) AS until FROM daily),
asked AS (
  SELECT page_id, day, 0 AS depth, 'u:' || h || path AS key FROM caps WHERE h <> ''
  UNION ALL
  SELECT page_id, day, i AS depth, 'h:' || array_to_string(string_split(h, '.')[i:], '.')
  FROM caps, LATERAL (SELECT unnest(range(1, 1 + greatest(len(string_split(h, '.')) - 1, 1))) AS i) WHERE h <> ''),
best AS (
  SELECT a.page_id, arg_min(iv.key, depth) AS list_key, arg_min(iv.verdict, depth) AS verdict, arg_min(iv.since, depth) AS since
  FROM asked a JOIN iv ON a.key = iv.key AND iv.since <= a.day AND a.day < iv.until AND iv.verdict <> 'drop' GROUP BY a.page_id)
SELECT c.page_id, c.day, b.verdict, b.list_key, b.since FROM caps c LEFT JOIN best b ON c.page_id = b.page_id
"""
