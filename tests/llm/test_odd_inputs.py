"""Every operator on ids of several types, null ids, and columns named like those that it adds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, exact_dedup, filter_audit, html_extract, line_dedup, mixing, near_join, packing, quality, secrets, toxicity, url_filter
from tidewatch.scratch import scratch_path

#: Columns that some operator makes for itself.
OWN = ("log_weight", "site", "found", "rest", "n_lines", "n_dropped", "host", "path", "day", "lists", "url", "html", "key", "keep_id", "before", "range", "src", "carried", "row", "size", "taken", "digest", "rep", "component", "doc", "may", "label", "features", "items", "n_hit", "spans", "kept", "score", "predicted", "repeated", "nodes", "texts", "body", "up", "page", "blocks")


@pytest.fixture(scope="module", params=["int", "long", "string"])
def docs(request, odd):
    lone = odd.where("doc_id = 21").withColumn("doc_id", F.lit(None).cast("long"))
    d = odd.where("doc_id <> 12").unionByName(lone).withColumn("doc_id", F.col("doc_id").cast(request.param))
    return d.withColumns({c: F.lit("x") for c in OWN} | {"N_Lines_": F.lit(1), "LOG_WEIGHT_": F.lit(2)}).coalesce(2).cache()


@pytest.fixture(scope="module")
def labels(docs):
    return docs.where("doc_id IS NOT NULL").select("doc_id").distinct().withColumns({"quality": (F.col("doc_id").cast("int") % 3 > 0).cast("int"), "toxic": (F.col("doc_id").cast("int") % 2).cast("int")})


OPERATORS = {
    "toxicity": lambda d, l: toxicity.toxicity(d, l),
    "secrets": lambda d, l: secrets.find_secrets(d),
    "near_join": lambda d, l: near_join.near_duplicates(d),
    "decontaminate": lambda d, l: decontaminate.contamination(d, l.select(F.col("doc_id").alias("item_id"), F.lit("head line").alias("text"))),
    "line_dedup": lambda d, l: line_dedup.drop_boilerplate(d),
    "exact_dedup": lambda d, l: exact_dedup.DigestIndex(d.sparkSession, scratch_path(d.sparkSession, "index")).add(d),
    "mixing": lambda d, l: mixing.mix(d),
    "quality": lambda d, l: quality.resample(d, l),
    "html": lambda d, l: html_extract.extract(d.withColumnsRenamed({"doc_id": "page_id", "url": "u", "html": "h"}).withColumns({"url": F.lit("http://x.example/"), "html": F.col("text")})),
    "url_filter": lambda d, l: url_filter.evaluate(d.withColumns({"url": F.lit("http://casino-win.example.org/a"), "day": F.lit(dt.date(2024, 6, 1))}), url_filter.intervals(url_filter.changes(d.sparkSession)), "url", "day"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay(docs, labels, name):
    out = OPERATORS[name](docs, labels)
    assert out.count() == docs.count()


def test_filters_keep_columns(docs, labels):
    n = docs.count()
    for out in (quality.keep_good(docs, labels, 1.0), line_dedup.drop_boilerplate(docs).select(*docs.columns), decontaminate.keep_clean(docs, labels.select(F.col("doc_id").alias("item_id"), F.lit(None).cast("string").alias("text")))):
        assert out.columns == docs.columns and out.count() == n
    one = near_join.keep_one(docs)
    assert set(one.columns) == set(docs.columns) and one.where("doc_id IS NULL").count() == 1 and one.count() < n


def test_urls_in_disguise(spark):
    """What browsers take for the same host is the same host to the lists."""
    rows = ["http://casino-win.example.org/", "HTTP://Casino-Win.Example.ORG./x", "//casino-win.example.org/y", "http:\\\\casino-win.example.org\\z", "  http://casino%2Dwin.example.org", "http://u:p@www.casino-win.example.org:80/?q", "http://a@b@casino-win.example.org/", "ht\ttp://cas\nino-win.exam\tple.org/", "http:/casino-win.example.org/a", "https:casino-win.example.org", "///casino-win.example.org/b"]
    df = spark.createDataFrame([(u, dt.date(2024, 6, 1)) for u in [*rows, "http://casino-win.example.org.evil.example/", "/casino-win.example.org", None, "http://ok.example/@casino-win.example.org", "mailto:/casino-win.example.org"]], "url string, fetched_on date")
    got = [r.blocked for r in url_filter.evaluate(df.coalesce(1), url_filter.intervals(url_filter.changes(spark))).collect()]
    assert sorted(got) == [False] * 5 + [True] * 11


def test_quality_in_stretches(monkeypatch):
    text = "".join(f"wörd{k}, {'x' * (k % 40)}!! " for k in range(300))
    whole = sorted(quality.buckets(text).tolist())
    for reach in (1, 7, 64):
        monkeypatch.setattr(quality, "REACH", reach)
        assert sorted(quality.buckets(text).tolist()) == whole


def test_stragglers_are_paired_once(spark):
    """A leader's large component is not paired with itself; every pair with a straggler that the bound leaves is there once."""
    import itertools
    import random

    r = random.Random(3)
    rows = [(1, 1, 100, 100, 100, 1)] + [(1, b, r.randint(80, 100), 100, r.randint(90, 100), 1 if b < 60 else 60 + b % 4) for b in range(2, 70)]
    got = sorted((min(x), max(x)) for x in near_join._stragglers(spark.createDataFrame(rows, "a long, b long, overlap long, n long, m long, component long"), 80).collect())
    could = lambda x, y: (min(x[2], y[2]) + min(x[4] - x[2], y[4] - y[2])) * 180 >= (x[3] + y[3]) * 80
    want = sorted((x[1], y[1]) for x, y in itertools.combinations(rows[1:], 2) if x[5] != y[5] and could(x, y))
    assert got == want and len(want) > 100


def test_audit_and_packing_of_any_id(docs, labels):
    """Orders see every document; pieces of all ids come out."""
    n = docs.count()
    audit = filter_audit.audit(docs, labels).where("step = 1").groupBy("filter_order").agg(F.sum(F.col("kept") + F.col("removed")).alias("n")).collect()
    assert {r.n for r in audit} == {n} and len(audit) == 120
    packed = packing.pack(docs)
    assert packed.where("start = 0").count() == n and packed.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
