"""URL filters as a temporal list join.

Dated additions and removals of list entries become validity intervals. Every capture is evaluated against the entries active at
its fetch time: its host and each parent domain, alone, with each prefix of the path in whole segments, and with path and query,
are the keys of an equality join with the interval as further condition, which picks the same entry as a search for the latest
change at or before the fetch. Hosts compare without case, paths with it. Captures are first reduced to distinct (host, path
with query, fetch day), with map-side combine, so a site that holds a third of all rows costs at most one row a day, path and task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm._names import free
from tidewatch.scratch import written

#: Changes of the lists: list, key, action, day from which it holds.
CHANGES = (
    ("adult", "adult-x.example.net", "add", "2023-01-01"),
    ("ads", "ads-track.example.org", "add", "2024-02-01"),
    ("ads", "ads-track.example.org", "remove", "2024-05-01"),
    ("ads", "ads-track.example.org", "add", "2024-09-01"),
    ("gambling", "casino-win.example.org", "add", "2024-03-15"),
    ("gambling", "free-bets.example.com", "add", "2023-06-01"),
    ("gambling", "free-bets.example.com", "remove", "2024-08-01"),
    ("pharmacy", "cheap-pills.example.com", "add", "2023-12-01"),
    ("pharmacy", "cheap-pills.example.com", "remove", "2024-07-01"),
    ("spam", "spam-farm.example.org", "add", "2024-01-10"),
    ("spam", "cheap-pills.example.com", "add", "2024-06-01"),
    ("spam", "tiontion.example.com/fr", "add", "2024-04-01"),
)
FIRST_DAY = dt.date(2024, 1, 1)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)"
WEB = r"^((?i:https?|wss?|ftp)):/*"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^#]*)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)"


def changes(spark: SparkSession, rows: tuple[tuple[str, str, str, str], ...] = CHANGES) -> DataFrame:
    return spark.createDataFrame(list(rows), "list string, key string, action string, day string").withColumn("day", F.to_date("day"))


def intervals(changed: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to): each addition holds until the next change of that entry, or for ever.

    Changes without a list, key, action or day are void. Of changes of one entry on one day, a removal wins. Keys are hosts, hosts
    with a path, or whole URLs; the host's case, user, port, fragment and slashes at the end don't tell entries apart.
    """
    host, path = host_of(F.col("key")), path_of(F.col("key"))
    plain = F.split(F.regexp_replace("key", "#.*$", ""), "/", 2)
    host, path = F.when(host != "", host).otherwise(F.lower(plain[0])), F.when(host != "", path).otherwise(F.coalesce(F.get(plain, F.lit(1)), F.lit("")))
    changed = changed.withColumn("key", F.regexp_replace(F.concat(host, F.lit("/"), path), "/+$", ""))
    c = changed.where("list IS NOT NULL AND key IS NOT NULL AND action IS NOT NULL AND day IS NOT NULL").groupBy("list", "key", "day").agg(F.max("action").alias("action"))
    return c.withColumn("valid_to", F.lead("day").over(W.partitionBy("list", "key").orderBy("day"))).where("action = 'add'").select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def _plain(url: Column) -> Column:
    """A URL as browsers read it: no space around it, no tabs or line ends in it, back slashes as slashes, a scheme where only ``//``
    stands, and two slashes behind the schemes of the web however many there are."""
    u = F.translate(F.regexp_replace(F.translate(url, "\t\n\r", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "\\", "/")
    u = F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)
    return F.regexp_replace(u, WEB, "$1://")


def host_of(url: Column) -> Column:
    """Lower-case host, percent-decoded and without dots at its end; empty for a null or relative URL."""
    host = F.coalesce(F.regexp_extract(_plain(url), HOST, 1), F.lit(""))
    host = F.when(F.contains(host, F.lit("%")), F.coalesce(F.try_url_decode(host), host)).otherwise(host)
    return F.lower(F.rtrim(host, F.lit(".")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_plain(url), PATH, 1), F.lit(""))


def keys_of(host: Column, path: Column) -> Column:
    """The host and its parent domains, each alone and with each prefix of the path in whole segments, and with path and query."""
    parts = F.split(host, "[.]")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    segments = F.split(F.substring_index(path, "?", 1), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, 1, i), "/"))
    prefixes = F.filter(F.array_union(prefixes, F.array(path)), lambda x: (x != "") & ~F.endswith(x, F.lit("/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda x: F.concat_ws("/", d, x))))))


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """All rows and columns of ``captures`` with host, lists (names of the lists that hold it, sorted, comma-joined) and blocked.

    A null URL or day matches nothing. Rows that repeat each stay. Columns of these three names are replaced.
    """
    kept = [x for x in captures.columns if x.lower() not in ("host", "lists", "blocked")]
    names = free(captures, "host", "path", "day", "lists")
    host, path, day, lists = names
    url, fetched = F.col(url_col), F.col(day_col)
    c = captures.select(*kept, host_of(url).alias(host), path_of(url).alias(path), fetched.alias(day))
    each = c.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(day).alias("day")).where("host <> '' AND day IS NOT NULL").distinct().withColumn("key", F.explode(keys_of(F.col("host"), F.col("path"))))
    hit = (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    found = each.join(entries, "key").where(hit).groupBy("host", "path", "day").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))
    found = written(found, "url-hits").select(F.col("host").alias(host), F.col("path").alias(path), F.col("day").alias(day), F.col("lists").alias(lists))
    out = c.join(found, [host, path, day], "left")
    return out.select(*kept, F.col(host).alias("host"), F.coalesce(lists, F.lit("")).alias("lists"), F.col(lists).isNotNull().alias("blocked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time, so each gets a day of 2024 from its id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.date_add(F.lit(FIRST_DAY), (F.col("page_id") % 366).cast("int")).alias("fetched_on"))
    return evaluate(pages, intervals(changes(spark))).withColumn("fetched_on", F.col("fetched_on").cast("string"))


SQL = rf"""
WITH c(list, key, action, day) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in CHANGES)}),
i AS (SELECT * FROM (SELECT list, key, action, day AS valid_from, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS valid_to FROM c) WHERE action = 'add'),
p AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched_on, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
    coalesce(regexp_extract(url, '{SEGMENT}', 1), '') AS segment FROM pages
)
SELECT page_id, url, strftime(fetched_on, '%Y-%m-%d') AS fetched_on, host, coalesce(lists, '') AS lists, lists IS NOT NULL AS blocked
FROM (
  SELECT p.*, (SELECT string_agg(DISTINCT list, ',' ORDER BY list) FROM i WHERE valid_from <= p.fetched_on AND (valid_to IS NULL OR p.fetched_on < valid_to)
    AND (ends_with('.' || p.host, '.' || key) OR (p.segment <> '' AND ends_with('.' || p.host || '/' || p.segment, '.' || key)))) AS lists FROM p
)
"""
