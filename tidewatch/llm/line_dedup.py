"""Line deduplication by site-relative frequency, with DataFrame operations only.

A line is boilerplate of its site if the pages of the site that contain it, over all pages of the site, exceed a ratio. Lines
are counted once a page, as 64-bit hashes, with map-side combine: a line that a third of the rows share costs one row a task.
At most lines-a-page / ratio lines of a site can pass, so its list has a bounded length, but the lists of all sites together
have none: they are written, and Spark broadcasts them only if the files it finds are below its threshold, else it
sort-merges and splits a hot site. Two of one site's lines are mistaken for one with odds of about 2**-64 a pair.

Rows that repeat a page count as pages of their own, as in the SQL, so a group of copies over the ratio empties itself. With
``distinct``, as in the pipeline, each distinct page of a site counts once, for its lines as for the total: pages are the same if
their lines are, blank ones and spaces around them aside. Pages that differ in any line are different pages there too.

The floor of pages decides on sites of fewer than ``min_pages / max_ratio`` pages: with 5 and 0.05, a line needs 5 / pages of a
site of 5 to 99 pages (50 % of 10, 12.5 % of 40) and more than 5 % from 100 pages on; a footer of a site of 4 pages stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._names import free
from tidewatch.scratch import written

MAX_RATIO = 0.05
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(site, lines): hashes of each site's boilerplate lines; sites without any are absent."""
    d = docs.select(F.struct(F.col(host_col).isNull().alias("none"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("name")).alias("site"), F.col(text_col).alias("body"))
    d = d.select("site", F.filter(F.transform(_lines(F.col("body")), lambda x: F.trim(x)), lambda x: x != "").alias("own"))
    of = [F.xxhash64("own").alias("page")] if distinct else []
    pages, each = d.select("site", *of), d.select("site", *of, F.explode(F.array_distinct("own")).alias("line"))
    each = each.select("site", *of and ["page"], F.xxhash64("line").alias("line"))
    if distinct:
        pages, each = pages.distinct(), each.distinct()
    pages = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    seen = each.groupBy("site", "line").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= min_pages)
    return seen.join(pages, "site").where(F.col("seen") / F.col("pages") > max_ratio).groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the site's boilerplate lines gone from the text, and n_lines, n_dropped (with an underscore
    behind them where ``docs`` has such columns).

    Lines compare without the spaces around them; blank lines always stay. Null and empty texts become empty. A null site is a
    site of its own. Rows that repeat count as pages of their own, or once if ``distinct``. A site of fewer than ``min_pages`` pages loses nothing.
    """
    of_site, found, rest, n_lines, n_dropped = free(docs, "site", "found", "rest", "n_lines", "n_dropped")
    known = written(boilerplate(docs, max_ratio, min_pages, host_col, text_col, distinct), "boilerplate").select(F.col("site").alias(of_site), F.col("lines").alias(found))
    site = F.struct(F.col(host_col).isNull().alias("none"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("name"))
    joined = docs.withColumn(of_site, site).join(known, of_site, "left")
    lines = _lines(F.col(text_col))
    kept = F.when(F.col(found).isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(found), F.xxhash64(F.trim(x)))))
    out = joined.withColumn(rest, kept).withColumn(n_lines, F.size(lines).cast("long"))
    out = out.withColumn(n_dropped, F.col(n_lines) - F.size(rest)).withColumn(text_col, F.array_join(rest, "\n"))
    return out.select(*docs.columns, n_lines, n_dropped)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def sql(documents: str = "documents", columns: str = "doc_id, n_lines, n_lines - len(rest) AS n_dropped, array_to_string(rest, chr(10)) AS text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    return f"""
WITH d AS (SELECT *, source IS NULL AS site_none, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM {documents}),
pages AS (SELECT site_none, site, count(*) AS pages FROM d GROUP BY ALL),
each AS (SELECT site_none, site, unnest(list_distinct(list_transform(lines, lambda x: trim(x)))) AS line FROM d),
found AS (
  SELECT site_none, site, list(line) AS found FROM (SELECT site_none, site, line, count(*) AS seen FROM each WHERE line <> '' GROUP BY ALL HAVING count(*) >= {min_pages})
  JOIN pages USING (site_none, site) WHERE seen / pages > {max_ratio}::DOUBLE GROUP BY ALL
), kept AS (
  SELECT d.*, len(lines)::BIGINT AS n_lines, CASE WHEN found IS NULL THEN lines ELSE list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(found, trim(x))) END AS rest
  FROM d LEFT JOIN found USING (site_none, site)
)
SELECT {columns} FROM kept
"""


SQL = sql()
