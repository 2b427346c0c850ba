"""Jaccard self-join of documents on word n-grams, with vertical partitioning.

n-grams are 64-bit hashes and stand in one global order; the order is cut into fragments, and the overlaps of documents are
counted in each fragment on its own and summed per pair or document. Documents with equal sets are one class. Then:

1. Each class offers the first n-grams of its set, as many as two linked sets must partly share. Fragments count how many of
   them another class has too; a class with too few has no partner and goes. An n-gram that is frequent within a task counts
   there and is sent once, so a passage that a third of all documents share costs one entry a task.
2. What stays is ranked anew, rare n-grams first; sets whose n-grams with any other owner cannot make up the threshold go. Two
   linked sets share one of the first few n-grams. The class with the commonest n-grams among those that share one leads them.
3. Overlaps of leaders with those they lead are counted by fragment and summed per pair; links make components.
4. Pairs under one leader in different components remain. If linked, they share a good part of what they differ from the leader
   by: those that share a rare n-gram of it are looked at. With that, every link between two components has been
   looked at, and pairs inside a component need not be. A group of copies costs a row per member, and one per n-gram of its
   difference from the leader, rather than per pair; a pair costs a row where two differences share what few others have.

No cap or sample is used anywhere. Two n-grams of one pair share a hash with odds of about 2**-64 a pair of n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm._ngrams import shingles
from tidewatch.scratch import written
from tidewatch.shipping import ship

WORDS, PERCENT = 5, 80
FRAGMENTS = 2  # of the sets whose pairs are counted: a pair costs a row in each
FRAGMENT_TOKENS = 1 << 21  # about as many n-grams meet in a task of the first step
FILE_TOKENS = 1 << 21  # of the sets that may have partners, behind each file that is written for them
FLUSH_TOKENS = 1 << 20


def _spare(n: int, percent: int) -> int:
    """n-grams that a set of n may have outside the overlap with a partner."""
    return n - -(-percent * n // 100)


def _sketch(n_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text in b.column("text").to_pylist():
                s = shingles(text, n_words)
                head = s[: 2 * _spare(len(s), percent) + 1]
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, len(head), head.tobytes()))
            n, digest, heads, head = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(heads, pa.int64()), pa.array(head, pa.binary())], ["doc_id", "n", "digest", "n_head", "head"])

    return run


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(text, n_words) for text in b.column("text").to_pylist()]
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "n", "tokens"])

    return run


def _deal(fragments: int):
    """(digest, doc_id, head) -> per fragment the distinct n-grams of a stretch of rows with their owner, and without owners those
    that have several there; negative fragments have owners credited on the spot, with counts in place of n-grams."""

    def flush(heads: list[np.ndarray], docs: list[int]) -> pa.RecordBatch:
        token, owner = np.concatenate(heads), np.repeat(np.array(docs, np.int64), [len(h) for h in heads])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(first, len(token)))
        credited, credits = np.unique(owner[np.repeat(count > 1, count)], return_counts=True)
        token, owner, several = token[first], owner[first], count > 1
        part = 2 * (token % np.uint64(fragments)).astype(np.int64) + several
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(2 * fragments + 1))
        at = credited % fragments
        rows = [(-1 - k, credits[at == k].astype(np.int64).tobytes(), credited[at == k].tobytes()) for k in np.unique(at).tolist()]
        rows += [(k // 2, token[x].tobytes(), b"" if k % 2 else owner[x].tobytes()) for k in range(2 * fragments) if len(x := order[cuts[k] : cuts[k + 1]])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["fragment", "tokens", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # bounded by the rows of one input split
        heads, docs, held = [], [], 0
        for b in batches:
            for digest, doc, head in zip(b.column("digest").to_pylist(), b.column("doc_id").to_pylist(), b.column("head").to_pylist(), strict=True):
                if digest in seen:
                    continue
                seen.add(digest)
                heads.append(np.frombuffer(head, np.uint64))
                docs.append(doc)
                held += len(heads[-1])
                if held >= FLUSH_TOKENS:
                    yield flush(heads, docs)
                    heads, docs, held = [], [], 0
        if heads:
            yield flush(heads, docs)

    return run


def _shared(fragments: int):
    """One fragment: per owner, how many of its n-grams have another owner, or the sum of its credits; packed by part of the owners."""

    def run(t: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()])
        owners = t.column("owners").to_pylist()
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in owners])
        if t.column("fragment")[0].as_py() < 0:
            doc, at = np.unique(owner, return_inverse=True)
            n = np.bincount(at, weights=token).astype(np.int64)
        else:
            owned = np.repeat([bool(x) for x in owners], [len(x) // 8 for x in t.column("tokens").to_pylist()])
            of = np.zeros(len(token), np.int64)
            of[owned] = owner
            order = np.argsort(token, kind="stable")
            token, of, owned = token[order], of[order], owned[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(first, len(token)))
            doc, n = np.unique(of[(np.repeat(count, count) > 1) & owned], return_counts=True)
        part = doc % fragments
        parts = np.unique(part).tolist()
        return pa.table({"part": pa.array(parts, pa.int32()), "docs": pa.array([doc[part == k].tobytes() for k in parts], pa.binary()), "counts": pa.array([n[part == k].astype(np.int64).tobytes() for k in parts], pa.binary())})

    return run


def _summed(t: pa.Table) -> pa.Table:
    """One part of the owners: the sum of what the fragments counted."""
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("docs").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()])
    each, at = np.unique(doc, return_inverse=True)
    return pa.table({"doc_id": pa.array(each), "shared": pa.array(np.bincount(at, weights=n).astype(np.int64))})


def _spare_col(n, percent: int):
    return n - F.ceil(n * percent / F.lit(100)).cast("long")


def _candidates(sketch: DataFrame, percent: int) -> DataFrame:
    """doc_id of one row of each class that may have a partner."""
    total = sketch.agg(F.sum("n_head")).first()[0] or 0
    fragments = max(4, -(-total // FRAGMENT_TOKENS))
    dealt = sketch.where("n > 0").select("digest", "doc_id", "head").mapInArrow(_deal(fragments), "fragment int, tokens binary, owners binary")
    counts = dealt.groupBy("fragment").applyInArrow(_shared(fragments), "part int, docs binary, counts binary")
    counts = counts.groupBy("part").applyInArrow(_summed, "doc_id long, shared long")
    # Partners of a set of n have ceil(percent * n / 100) n-grams at least, and these have so many to spare.
    least = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")
    able = sketch.where("n > 0").join(counts, "doc_id").where(F.col("shared") > _spare_col(least, percent)).select("digest").distinct()
    reps = sketch.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return reps.join(able, "digest", "left_semi").select("doc_id")


def _overlap(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [_overlap(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(n, pa.int64())], ["a", "b", "part"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted n-grams of a set by fragment: contiguous ranges of the global order."""
    cuts = np.array([(k << 64) // FRAGMENTS - (1 << 63) for k in range(1, FRAGMENTS)], np.int64)
    for b in batches:
        doc, part, seg = [], [], []
        for d, tokens in zip(b.column("doc_id").to_pylist(), b.column("tokens"), strict=True):
            t = np.sort(tokens.values.to_numpy())
            for k, s in enumerate(np.split(t, np.searchsorted(t, cuts))):
                if len(s):
                    doc.append(d), part.append(k), seg.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(seg, pa.binary())], ["doc_id", "fragment", "segment"])


def _count(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, overlap): overlaps of each fragment, summed per pair; pairs without any are absent."""
    x = segments.select(F.col("doc_id").alias("a"), "fragment", F.col("segment").alias("x"))
    y = segments.select(F.col("doc_id").alias("b"), "fragment", F.col("segment").alias("y"))
    parts = pairs.join(y, "b").join(x, ["a", "fragment"]).select("a", "b", "x", "y").mapInArrow(_overlaps, "a long, b long, part long")
    return parts.groupBy("a", "b").agg(F.sum("part").alias("overlap"))


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(a, b) -> (doc_id, component): the smallest id that edges reach from each; ids without an edge are absent.

    Smallest labels spread along edges and then jump to the label's own label, so chains shorten by halves; each round is
    written. Nulls are not ids: such edges are void.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", files)
    labels = written(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "doc_id"), "labels", files)
    while True:
        near = e.join(labels.select(F.col("doc_id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "doc_id"), "doc_id").select("doc_id", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        far = labels.select(F.col("doc_id").alias("low"), F.col("label").alias("far"))
        labels = written(low.join(far, "low", "left").select("doc_id", "was", F.least("low", F.coalesce("far", "low")).alias("label")), "labels", files)
        if labels.where("label <> was").isEmpty():
            return labels.select("doc_id", F.col("label").alias("component"))
        labels = labels.drop("was")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, component) of the sets that are linked with another."""
    files = max(2, -(-(sets.agg(F.sum("n")).first()[0] or 0) // FILE_TOKENS))
    tokens = sets.select("doc_id", "n", F.explode("tokens").alias("token"))
    owners = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(owners, "token").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    ranked = ranked.withColumn("m", F.size("r").cast("long")).where(F.col("m") * 100 >= F.col("n") * percent)
    own = F.col("n") - F.col("m")  # n-grams that only this set has come first
    first = F.greatest(F.lit(0), _spare_col(F.col("n"), percent) + 1 - own).cast("int")
    common = F.aggregate("r", F.lit(0.0), lambda s, x: s + F.log2(x["df"].cast("double"))) / F.col("n")
    ranked = written(ranked.select("doc_id", "n", "m", common.alias("common"), F.slice(F.col("r.token"), F.lit(1), first).alias("first")), "ranked", files)

    by_token = ranked.select("doc_id", "common", F.explode("first").alias("token"))
    led = by_token.groupBy("token").agg(F.max(F.struct("common", F.bitwise_not("doc_id").alias("id"))).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", F.bitwise_not("top.id").alias("a"))
    stars = by_token.join(led, "token").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    size = ranked.select("doc_id", "n", "m")
    near = ranked.select("doc_id").join(stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct(), "doc_id", "left_semi")
    segments = written(sets.join(near, "doc_id", "left_semi").select("doc_id", "tokens").mapInArrow(_segments, "doc_id long, fragment int, segment binary"), "segments", files)

    def linked(pairs: DataFrame) -> DataFrame:
        of = lambda c: size.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("m").alias(f"m_{c}"))
        return _count(pairs, segments).join(of("b"), "b").join(of("a"), "a").withColumn("link", F.col("overlap") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)

    counted = written(linked(stars), "stars", max(2, files // 2))
    links = counted.where("link").select("a", "b")
    few = max(1, files // 4)  # of pairs of ids
    labels = components(links, few)

    led = counted.select("a", "b", "overlap", F.col("n_b").alias("n"), F.col("m_b").alias("m"))
    led = led.unionByName(counted.select("a", F.col("a").alias("b"), F.col("n_a").alias("overlap"), F.col("n_a").alias("n"), F.col("m_a").alias("m")).distinct())
    led = led.join(labels.withColumnRenamed("doc_id", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    mixed = led.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("a")
    led = led.join(mixed, "a", "left_semi")
    rest = _stragglers(led, sets, percent)
    more = written(linked(rest).where("link").select("a", "b"), "more-links", few)
    return labels if more.isEmpty() else components(links.unionByName(more), few)


def _stragglers(led: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs under one leader in different components that may be linked, from (a, b, overlap, n, m, component).

    A member differs from its leader by few n-grams, those that only one of the two has, and two members differ by the n-grams in which
    these differences do. So linked members share a good part of their differences. As linked partners of the leader are of its
    component, one of a pair is not linked with it (``far``), and that alone makes the part more than nothing: the pair meets at an
    n-gram that stands early in both differences, rare ones first, and then all of both are compared. Members are never paired by
    their leader alone, and one that differs from its leader where no other component does meets nobody.
    """
    led = written(led, "led")
    most = led.groupBy("a", "component").count().groupBy("a").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    led = led.join(most, "a").where("a <> b").withColumn("away", F.col("component") != F.col("main"))
    ids = led.select(F.col("a").alias("doc_id")).unionByName(led.select(F.col("b").alias("doc_id"))).distinct()
    told = written(sets.join(ids, "doc_id", "left_semi").select("doc_id", "n", "tokens"), "told")
    leader = told.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("x"))
    diff = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    both = led.join(told.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b").join(leader, "a")
    # Twice the n-grams that the differences of linked members share, times 100 + percent, is at least the sum of both sides' ``weigh``.
    weigh, gap = lambda d, n: d * (100 + percent) - n * (100 - percent), F.col("n_a") * (100 - percent)
    both = both.select("a", "b", "n_a", "n", "component", "away", diff.alias("diff")).withColumn("weight", weigh(F.size("diff").cast("long"), F.col("n")))
    both = written(both.withColumn("far", F.col("weight") > gap).withColumn("least", F.col("weight") + gap).drop("n", "n_a"), "differences")
    each = both.select(*[c for c in both.columns if c != "diff"], F.explode("diff").alias("token"))
    shared = each.groupBy("a", "token").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("a", "token", "df")
    each = each.join(shared, ["a", "token"])
    # ``left``: n-grams of the difference from this one on, of those that another component has in its differences too.
    left = F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc("df"), F.desc("token"))).cast("long")
    each = each.withColumn("left", left * (2 * (100 + percent))).withColumn("early", F.col("left") >= F.col("least")).where("far OR early")
    each = written(each.select("a", "b", "token", "component", "away", "weight", "far", "early", "left"), "early")
    of = lambda d, c: d.select("a", "token", *[F.col(x).alias(f"{x}_{c}") for x in ("b", "component", "away", "weight", "left")])
    far, enough = each.where("far"), F.expr("component_u <> component_v AND least(left_u, left_v) >= weight_u + weight_v")
    pairs = of(far.where("early AND away"), "u").join(of(far.where("early"), "v"), ["a", "token"]).where(enough).where("NOT away_v OR b_u < b_v")
    pairs = pairs.unionByName(of(far, "u").join(of(each.where("NOT far"), "v"), ["a", "token"]).where(enough))
    side = lambda c: both.select("a", F.col("b").alias(f"b_{c}"), F.col("diff").alias(f"diff_{c}"), F.col("weight").alias(f"weight_{c}"))
    pairs = pairs.select("a", "b_u", "b_v").distinct().join(side("u"), ["a", "b_u"]).join(side("v"), ["a", "b_v"])
    pairs = pairs.where(F.size(F.array_intersect("diff_u", "diff_v")) * (2 * (100 + percent)) >= F.col("weight_u") + F.col("weight_v"))
    return pairs.select(F.col("b_u").alias("a"), F.col("b_v").alias("b")).distinct()


def _one_text(rows: DataFrame) -> DataFrame:
    """Of rows that repeat an id, the least text by hash."""
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def near_duplicates(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set), component_id (smallest doc_id that links reach, itself included).

    Sets link when 100 * intersection >= percent * union. Null, empty and blank texts have no set and no links. A doc_id is taken
    to stand for one text: rows that repeat share their component. Other columns are not read. Rows with null ids are linked
    with nothing and have a null component. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = written(rows.mapInArrow(_sketch(n_words, percent), "doc_id long, n long, digest binary, n_head long, head binary"), "sketch")
    known = sketch.where("doc_id IS NOT NULL")
    able = written(_candidates(known, percent), "able")  # its size tells Spark how to join the texts
    sets = _one_text(rows.join(able, "doc_id", "left_semi")).mapInArrow(_sets(n_words), "doc_id long, n long, tokens array<long>")
    labels = _links(written(sets, "sets"), percent)
    classes = known.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the smallest doc_id; of rows that repeat an id, that with the least text by hash. Rows with
    null ids stay.

    All columns; texts without words are linked with nothing and stay.
    """
    found = near_duplicates(docs, n_words, percent)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


def sql(documents: str = "documents", n_words: int = 4, percent: int = 85, columns: str = "doc_id, n_shingles, component_id", before: str = "") -> str:
    """Components by repeated spread of the smallest id along links."""
    return rf"""
WITH RECURSIVE {before} w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {n_words - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {n_words - 1}], ' '))) AS s FROM w WHERE len(w) > 0
), t AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS t FROM s),
f AS MATERIALIZED (SELECT t FROM t GROUP BY t HAVING count(*) > 1),
u AS MATERIALIZED (SELECT doc_id, n, t FROM t SEMI JOIN f USING (t)),
m AS MATERIALIZED (SELECT doc_id FROM u GROUP BY doc_id, n HAVING count(*) * 100 >= n * {percent}),
v AS MATERIALIZED (SELECT * FROM u SEMI JOIN m USING (doc_id)),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM v a JOIN v b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a),
near AS (SELECT d.doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id FROM {documents} d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT {columns} FROM near
"""


SQL = sql()
