"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over the tokens of the host's pages (block elements and texts). Token streams are
aligned from the root down: tokens of one signature below aligned parents are partners. A token that some page lacks becomes
optional, one that stands in varying number becomes repeated, tokens that follow each other in both orders become one repeated
group, such as ``(h2 p+)+``, and texts that differ become slots. What is kept of a place are minima, maxima, sums and sets, so
pages can be aligned in any order and in any number of tasks, a host needs no task of its own, and copies change nothing.

Places where every page has the same number of tokens are aligned by position, so the first, second and third ``div`` of a page
without telling names are three nodes; repeated ones are one node. Then the text of each node is looked at over the host:

* A node is of the template if most of its texts stand there on other pages too, and so is a text that most pages have there.
* A node is a menu if most of its text is links.
* All others are slots, and hold main text.

Copies and near copies show nothing of the template: copies count once, and a page most of whose text also stands elsewhere on
the host is not asked. So a host with thin pages or with copies only keeps its boilerplate rather than lose its text.

Marks of the page come first: what it marks as menu, footer, advert and so on is never main text, and what it marks as its article
is, whether other pages have the same or not. On all other pages the wrapper alone decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.html_page import TEXT, Page
from tidewatch.llm.url_filter import host_of
from tidewatch.scratch import written
from tidewatch.shipping import ship

COPY_SHARE = 0.8  # a page with more of its text than this on other pages is a near copy
MOST = 0.5  # more than this share of texts, pages or characters is most of them

_PLACE = pa.struct([("ctx", pa.int64()), ("parent", pa.int64()), ("sig", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()), ("n", pa.int32()), ("parents", pa.int32()), ("first", pa.int32()), ("after", pa.list_(pa.int64())), ("ends", pa.bool_())])
_PLACE_SQL = "struct<ctx:long,parent:long,sig:string,lo:int,hi:int,n:int,parents:int,first:int,after:array<long>,ends:boolean>"
_TOKENS = "up array<int>, ctx array<long>, nth array<int>, leaf array<int>, body array<string>, main array<boolean>, link array<boolean>"
_HALF, _ODD, _ALL = 1 << 63, 0x9E3779B97F4A7C15, (1 << 64) - 1


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages = [Page(x) for x in b.column("html").to_pylist()]
        ints, bools = pa.list_(pa.int32()), pa.list_(pa.bool_())
        new = {
            "up": pa.array([p.up for p in pages], ints), "ctx": pa.array([p.ctx for p in pages], pa.list_(pa.int64())), "nth": pa.array([p.nth for p in pages], ints),
            "leaf": pa.array([p.leaf for p in pages], ints), "body": pa.array([p.text for p in pages], pa.list_(pa.string())), "main": pa.array([p.main for p in pages], bools),
            "link": pa.array([p.link for p in pages], bools), "places": pa.array([p.places() for p in pages], pa.list_(_PLACE)),
        }
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), *new.values()], ["page_id", "url", "host", *new])


def parsed(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, host and its tokens; each page is parsed once and written."""
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    return written(rows.mapInArrow(_parse, f"page_id {kind}, url string, host string, {_TOKENS}, places array<{_PLACE_SQL}>"), "pages")


def places(tokens: DataFrame) -> DataFrame:
    """The aligned places of each host: (host, ctx, parent, sig, repeated, several, optional, first, after, ends).

    ``repeated``: parents have it in varying number. ``several``: a parent may have more than one.
    """
    each = tokens.select("host", F.explode("places").alias("p")).select("host", "p.*")
    of = each.groupBy("host", "ctx").agg(
        F.min("parent").alias("parent"), F.min("sig").alias("sig"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("parents").alias("parents"), F.min("first").alias("first"),
        F.array_distinct(F.flatten(F.collect_set("after"))).alias("after"), F.max("ends").alias("ends"),
    )
    above = of.select("host", F.col("ctx").alias("parent"), F.col("n").alias("all"))
    of = of.join(above, ["host", "parent"], "left")
    return of.select("host", "ctx", "parent", "sig", (F.col("lo") < F.col("hi")).alias("repeated"), (F.col("hi") > 1).alias("several"), (F.col("parents") < F.coalesce("all", "parents")).alias("optional"), "first", "after", "ends")


def _groups(after: dict[int, set[int]]) -> dict[int, int]:
    """Tokens that follow each other in both orders have one number (strongly connected components, without recursion)."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    group: dict[int, int] = {}
    path: list[int] = []
    for start in after:
        if start in number:
            continue
        todo = [(start, iter(after[start]))]
        number[start] = low[start] = len(number)
        path.append(start)
        while todo:
            x, rest = todo[-1]
            y = next(rest, None)
            if y is None:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == number[x]:
                    while True:
                        z = path.pop()
                        group[z] = number[x]
                        if z == x:
                            break
            elif y not in number:
                number[y] = low[y] = len(number)
                path.append(y)
                todo.append((y, iter(after[y])))
            elif y not in group:
                low[x] = min(low[x], number[y])
    return group


def expression(children: list[dict]) -> str:
    """What may stand below a node, from its places: a union-free regular expression over their signatures."""
    by = {x["ctx"]: x for x in children}
    after = {c: {b for b in x["after"] if b in by and b != c} for c, x in by.items()}
    group = _groups(after)
    members: dict[int, list[int]] = {}
    for c in sorted(by, key=lambda c: (by[c]["first"], by[c]["sig"], c)):
        members.setdefault(group[c], []).append(c)
    waits = {g: {group[b] for c in cs for b in after[c]} - {g} for g, cs in members.items()}
    out, done = [], set()
    while len(done) < len(members):  # groups follow those that stand before them
        g = next(g for g in members if g not in done and waits[g] <= done)
        done.add(g)
        cs = members[g]
        at = {c: k for k, c in enumerate(cs)}
        again = {c for c in cs if by[c]["several"] and c in by[c]["after"]}
        if len(cs) == 1:
            c = cs[0]
            out.append(by[c]["sig"] + ("*" if by[c]["optional"] and again else "+" if again else "?" if by[c]["optional"] else ""))
            continue
        skipped: set[int] = set()
        for c in cs:
            for b in by[c]["after"]:
                if b in at and b != c:
                    skipped |= set(cs[at[b] + 1 : at[c]]) if at[b] < at[c] else {*cs[at[b] + 1 :], *cs[: at[c]]}
                elif b not in at:  # the group may start here
                    skipped |= set(cs[: at[c]])
            if by[c]["ends"] or any(c in after[y] for y in by if y not in at):  # or end here
                skipped |= set(cs[at[c] + 1 :])
        inner = " ".join(by[c]["sig"] + ("*" if c in skipped and c in again else "+" if c in again else "?" if c in skipped else "") for c in cs)
        out.append(f"({inner}){'*' if all(by[c]['optional'] for c in cs) else '+'}")
    return " ".join(out)


def _express(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("node"), pa.array([expression(x) for x in b.column("children").to_pylist()], pa.string())], ["host", "node", "below"])


def wrappers(tokens: DataFrame) -> DataFrame:
    """The wrapper of each host, a row a node: (host, node, parent, sig, repeated, optional, below), ``below`` the expression of its
    children. The root has no signature."""
    of = places(tokens)
    columns = ("ctx", "sig", "several", "optional", "first", "after", "ends")
    shown = of.groupBy("host", F.col("parent").alias("node")).agg(F.collect_list(F.struct(*columns)).alias("children")).mapInArrow(_express, "host string, node long, below string")
    nodes = of.where(F.col("sig") != TEXT).select("host", F.col("ctx").alias("node"), "parent", "sig", "repeated", "optional")
    root = of.select("host").distinct().select("host", F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit("").alias("sig"), F.lit(False).alias("repeated"), F.lit(False).alias("optional"))
    return nodes.unionByName(root).join(shown, ["host", "node"], "left").withColumn("below", F.coalesce("below", F.lit("")))


def _nodes(up: list[int], ctx: list[int], nth: list[int], repeated: set[int]) -> list[int]:
    """The wrapper's node of each token: its place, and its position wherever the host's pages agree on the number."""
    out: list[int] = []
    for u, c, k in zip(up, ctx, nth, strict=True):
        h = ((((out[u] if u >= 0 else 0) + c) * _ODD) ^ (0 if c in repeated else k)) & _ALL
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & _ALL
        out.append((h ^ (h >> 29)) - _HALF)
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its distinct (node, digest of the text) with characters, marks and links, and a digest of the whole page."""
    kind = pa.list_(pa.struct([("node", pa.int64()), ("digest", pa.int64()), ("chars", pa.int64()), ("main", pa.bool_()), ("linked", pa.int64())]))
    for b in batches:
        blocks, digests = [], []
        columns = [b.column(c).to_pylist() for c in ("up", "ctx", "nth", "leaf", "digests", "chars", "main", "link", "repeated")]
        for up, ctx, nth, leaf, own, chars, main, link, repeated in zip(*columns, strict=True):
            node = _nodes(up, ctx, nth, set(repeated or ()))
            found: dict[tuple[int, int], list] = {}
            for t, d, n, m, a in zip(leaf, own, chars, main, link, strict=True):
                x = found.setdefault((node[t], d), [node[t], d, 0, m, 0])
                x[2] += n
                x[4] += n * a
            blocks.append(list(map(tuple, found.values())))
            digests.append(int.from_bytes(hashlib.blake2b(repr([(node[t], d) for t, d in zip(leaf, own, strict=True)]).encode(), digest_size=8).digest(), "big", signed=True))
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(digests, pa.int64()), pa.array(blocks, kind)], ["host", "page", "blocks"])


def _digests(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.xxhash64(x))


def verdicts(tokens: DataFrame) -> DataFrame:
    """(host, repeated, nodes, texts): places that are repeated, nodes of the template or of menus, and (node, digest of a text)
    that most pages have. Hosts without any are absent. A host's lists are as long as its template."""
    of = written(places(tokens).where("repeated").groupBy("host").agg(F.collect_list("ctx").alias("repeated")), "repeated")
    leaves = tokens.select("host", "up", "ctx", "nth", "leaf", _digests(F.col("body")).alias("digests"), F.transform("body", lambda x: F.length(x).cast("long")).alias("chars"), "main", "link").where(F.size("leaf") > 0)
    aligned = leaves.join(of, "host", "left").mapInArrow(_align, "host string, page long, blocks array<struct<node:long,digest:long,chars:long,main:boolean,linked:long>>")
    aligned = written(aligned.dropDuplicates(["host", "page"]), "aligned")

    each = aligned.select("host", "page", F.explode("blocks").alias("b")).select("host", "page", "b.*")
    common = each.groupBy("host", "node", "digest").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")
    common = written(common.select("host", "node", "digest", F.lit(True).alias("common")), "common-texts")
    share = each.join(common, ["host", "node", "digest"], "left").groupBy("host", "page").agg((F.sum(F.when(F.col("common"), F.col("chars")).otherwise(0)) / F.sum("chars")).alias("share"))
    asked = written(share.where(F.col("share") <= COPY_SHARE).select("host", "page"), "asked")

    open_to = each.where("NOT main").join(asked, ["host", "page"], "left_semi")
    texts = written(open_to.groupBy("host", "node", "digest").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")), "texts")
    nodes = texts.groupBy("host", "node").agg(F.sum("pages").alias("all"), F.sum(F.when(F.col("pages") > 1, F.col("pages")).otherwise(0)).alias("shared"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    of_page = open_to.select("host", "page", "node").distinct().groupBy("host", "node").agg(F.count(F.lit(1)).alias("having")).where("having > 1")
    nodes = written(nodes.join(of_page, ["host", "node"]), "nodes")
    gone = nodes.where((F.col("shared") > MOST * F.col("all")) | (F.col("linked") > MOST * F.col("chars")))
    constant = texts.where("pages > 1").join(nodes, ["host", "node"]).where(texts["pages"] > MOST * F.col("having")).select("host", F.struct("node", "digest").alias("t"))
    found = gone.groupBy("host").agg(F.collect_list("node").alias("nodes")).join(constant.groupBy("host").agg(F.collect_list("t").alias("texts")), "host", "full")
    return written(of.join(found, "host", "full"), "verdicts")


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        columns = [b.column(c).to_pylist() for c in ("up", "ctx", "nth", "leaf", "digests", "body", "repeated", "nodes", "texts")]
        for up, ctx, nth, leaf, digests, body, repeated, nodes, texts in zip(*columns, strict=True):
            node, gone = _nodes(up, ctx, nth, set(repeated or ())), set(nodes or ())
            constant = {(x["node"], x["digest"]) for x in texts or ()}
            out.append("\n".join(t for k, d, t in zip(leaf, digests, body, strict=True) if node[k] not in gone and (node[k], d) not in constant))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def main_text(source: str | None) -> str:
    """Main text of a page by its own marks: what a host with this page only gives."""
    page = Page(source)
    article = [t for t, m in zip(page.text, page.main, strict=True) if m]
    return "\n".join(article or page.text)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (main text, empty if none), n_chars (its code points).

    Null and empty pages have no text; rows that repeat are each extracted; pages without a host share a wrapper of their own.
    Pages without a marked article are joined with the verdict of their host, which Spark broadcasts only if the written table is
    below its threshold; else it sort-merges and splits a hot host. Only page_id, url and html are read.
    """
    tokens = parsed(pages)
    kind = dict(tokens.dtypes)["page_id"]
    marked = F.exists("main", lambda x: x)
    article = F.transform(F.filter(F.arrays_zip("body", "main"), lambda x: x["main"]), lambda x: x["body"])
    sure = tokens.where(marked).select("page_id", "url", F.array_join(article, "\n").alias("text"))
    rest = tokens.where(~marked).select("page_id", "url", "host", "up", "ctx", "nth", "leaf", "body", _digests(F.col("body")).alias("digests"))
    rest = rest.join(verdicts(tokens), "host", "left").drop("host").mapInArrow(_pick, f"page_id {kind}, url string, text string")
    return sure.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
