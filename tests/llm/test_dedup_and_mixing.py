import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, line_dedup, mixing, near_join, url_filter
from tidewatch.llm._ngrams import shingles, words
from tidewatch.scratch import scratch_path, shared_folder


def index(spark):
    return exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), buckets=4)


def test_exact(spark, odd, clashing, none, duck, rows_of):
    distinct = odd.dropDuplicates(["doc_id"])
    assert rows_of(index(spark).add(distinct).toPandas()) == rows_of(duck(exact_dedup.SQL, documents=distinct))
    got = index(spark).add(clashing).toPandas()
    assert len(got) == odd.count() and got[got.doc_id == 2].keep_id.item() == 2 and got[got.doc_id == 1].group_size.tolist() == [3, 3]
    assert index(spark).add(none).count() == 0


def test_exact_across_batches(spark):
    i = index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in i.add(first).collect()} == {1: 3, 2: 2, 3: 3}
    second = {r.doc_id: (r.keep_id, r.kept) for r in i.add(spark.createDataFrame([(9, "a"), (10, "c")], "doc_id long, text string")).collect()}
    assert second == {9: (3, False), 10: (10, True)}
    again = exact_dedup.DigestIndex(spark, i.path, i.buckets)
    assert again.entries().count() == 3
    plan = again.entries().hint("merge").join(again.entries().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan


def test_lines(spark, odd, clashing, none, duck, rows_of):
    distinct = odd.dropDuplicates(["doc_id"])
    got = line_dedup.drop_boilerplate(distinct).select("doc_id", "n_lines", "n_dropped", "text")
    assert rows_of(got.toPandas()) == rows_of(duck(line_dedup.SQL, documents=distinct))
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[16] == "" and texts[14].startswith("\n") and texts[4] == "" and "head line" not in texts[15]
    out = line_dedup.drop_boilerplate(clashing)
    assert set(clashing.columns) < set(out.columns) and out.count() == odd.count()
    assert line_dedup.drop_boilerplate(none).count() == 0


def test_line_ratio(spark):
    rows = [(k, f"same\nown {k}" if k < 6 else f"own {k}", "h") for k in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert line_dedup.drop_boilerplate(d, max_ratio=0.05).where("text LIKE 'same%'").count() == 0
    assert line_dedup.drop_boilerplate(d, max_ratio=0.06).where("text LIKE 'same%'").count() == 6


@pytest.mark.parametrize("pages,with_line,dropped", [(4, 4, 0), (10, 4, 0), (10, 5, 5), (40, 4, 0), (40, 5, 5), (60, 5, 5), (120, 6, 0), (120, 7, 7)])
def test_line_floor(spark, duck, rows_of, pages, with_line, dropped):
    rows = [(k, f"same\nown {k}" if k < with_line else f"own {k}", "h") for k in range(pages)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.drop_boilerplate(d).select("doc_id", "n_lines", "n_dropped", "text").toPandas()
    assert got.n_dropped.sum() == dropped and rows_of(got) == rows_of(duck(line_dedup.SQL, documents=d))


def test_mix(spark, odd, clashing, none, duck, rows_of):
    distinct = odd.dropDuplicates(["doc_id"])
    assert rows_of(mixing.mix(distinct).toPandas()) == rows_of(duck(mixing.SQL, documents=distinct))
    assert rows_of(mixing.mix(distinct).toPandas()) == rows_of(mixing.mix(distinct.repartition(5)).toPandas())
    assert mixing.mix(clashing).count() == odd.count() and mixing.mix(none).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).first().taken == 0


@pytest.mark.parametrize("seed", range(3))
def test_mix_budgets(spark, seed):
    r = random.Random(seed)
    sizes = [(k, " ".join(["w"] * r.randint(0, 40)), r.choice("abcde") if r.random() < 0.9 else None) for k in range(300)]
    got = mixing.mix(spark.createDataFrame(sizes, "doc_id long, text string, source string")).toPandas()
    total = got["size"].sum()
    by = got.assign(s=got.doc_id.map({k: s or "~" for k, _, s in sizes})).groupby("s").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - total) < 1e-6 * total
    assert (by.taken == by.target.astype(int)).all() and (got.taken <= 3 * got["size"]).all()
    # Brute force: share by weight, stop at three times the size, share the rest again.
    left, open_, want = float(total), {s: 1 + k % 3 for k, s in enumerate(sorted(by.index))}, {}
    while open_:
        unit = left / sum(open_.values())
        over = [s for s, w in open_.items() if unit * w > 3 * by["size"][s]]
        if not over:
            want |= {s: unit * w for s, w in open_.items()}
            break
        for s in over:
            want[s] = 3.0 * by["size"][s]
            left -= want[s]
            del open_[s]
    assert all(abs(want[s] - by.target[s]) < 1e-6 * total for s in by.index)


def brute_components(rows, n, percent):
    sets = {d: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if (w := words(t)) else set() for d, t, *_ in rows}
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_odd(spark, odd, clashing, none):
    rows = {(r.doc_id, r.text) for r in odd.collect()}
    want = brute_components(rows, 5, 80)
    got = near_join.near_duplicates(clashing).collect()
    assert len(got) == odd.count() and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert near_join.near_duplicates(none).count() == 0 and near_join.keep_one(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_near_brute_force(spark, seed):
    """Groups of copies edited about as much as the threshold allows, chains of edits, common passages, short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    common = [word() for _ in range(30)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(r.choice((6, 40, 90)))]
        at = list(base)
        for _ in range(r.randint(1, 14)):
            copy = list(at if r.random() < 0.5 else base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            at = copy
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join([word() for _ in range(20)] + common)) for k in range(15)]
    want = brute_components(rows, 4, 85)
    got = near_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert len({c for _, c in want.values()}) < len(rows) - 4


def test_near_negative_ids(spark):
    """Ids of any sign, the members of a group in different partitions."""
    r = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(60)]
        for k in range(1 + g % 4):
            copy = list(base)
            if k:
                copy[r.randrange(60)] = "other"
            rows.append((r.randrange(-(1 << 63), 1 << 63) if g else -(1 << 63), " ".join(copy)))
    rows.append((-1, rows[1][1]))
    got = near_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows)), 4, 80).collect()
    want = brute_components(rows, 4, 80)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want and sum(d != c for d, (_, c) in want.items()) > 12


def test_keep_one(spark, odd):
    kept = near_join.keep_one(odd)
    ids = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == odd.columns and 1 in ids and 2 not in ids and 3 not in ids and 5 in ids and len(ids) == len(set(ids))


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (None, 3)]
    got = {r.doc_id: r.component for r in near_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def test_shingles_do_not_depend_on_place():
    a, b = shingles("x y z one two three four", 4), shingles("ONE two\tthree  four", 4)
    assert len(b) == 1 and b[0] in a and len(shingles("  ", 4)) == 0 and len(shingles("a b", 4)) == 1


def test_urls(spark, none):
    day = "2024-06-15"
    rows = [(1, "http://www.ads-track.example.org/x", "2024-03-01"), (2, "http://ads-track.example.org", "2024-06-15"), (3, "HTTPS://User:p@Sub.ADS-track.example.org:80/", "2024-09-01"), (4, None, day), (5, "not a url", day), (6, "http://xads-track.example.org/", "2024-03-01"), (7, "http://www.cheap-pills.example.com/a", day), (8, "http://blog.tiontion.example.com/fr/2", day), (9, "http://blog.tiontion.example.com/en/2", day), (10, "http://adult-x.example.net", None), (1, "http://www.ads-track.example.org/x", "2024-03-01")]
    c = spark.createDataFrame(rows, "page_id long, url string, fetched_on string").withColumns({"fetched_on": F.to_date("fetched_on"), "host": F.lit("clash"), "key": F.lit("k"), "list": F.lit("l")})
    got = url_filter.evaluate(c, url_filter.intervals(url_filter.changes(spark))).collect()
    assert sorted((r.page_id, r.lists) for r in got) == [(1, "ads"), (1, "ads"), (2, ""), (3, "ads"), (4, ""), (5, ""), (6, ""), (7, "pharmacy,spam"), (8, "spam"), (9, ""), (10, "")]
    assert all(r.blocked == bool(r.lists) for r in got) and {r.host for r in got if r.page_id == 3} == {"sub.ads-track.example.org"}
    assert url_filter.evaluate(c.limit(0), url_filter.intervals(url_filter.changes(spark))).count() == 0


def test_url_entries_with_paths(spark):
    """Case of hosts and paths, deeper paths, whole URLs, and a removal that writes the host otherwise."""
    rows = (("a", "One.example/FR", "add", "2024-01-01"), ("b", "two.example/a/b/", "add", "2024-01-01"), ("c", "https://u@Three.example:80/x/Y?q=1#top", "add", "2024-01-01"), ("d", "four.example", "add", "2024-01-01"), ("d", "Four.Example", "remove", "2024-03-01"), ("e", None, "add", "2024-01-01"))
    urls = {"http://one.example/FR/2": "a", "http://one.example/fr/2": "", "http://www.two.example/a/b/c": "b", "http://two.example/a/b": "b", "http://two.example/a/b/?z": "b", "http://two.example/a/bc": "", "http://two.example/a": "", "http://three.example/x/Y?q=1": "c", "http://three.example/x/Y": "", "http://four.example/": ""}
    c = spark.createDataFrame([(u, "2024-06-15") for u in urls], "url string, fetched_on string").withColumn("fetched_on", F.to_date("fetched_on"))
    got = url_filter.evaluate(c, url_filter.intervals(url_filter.changes(spark, rows))).collect()
    assert {r.url: r.lists for r in got} == urls


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_stragglers_that_buckets_tell_apart_are_not_paired(spark, monkeypatch):
    """Members of a large group and stragglers beside it, with edits at other places, so that overlaps with the leader alone can't tell
    them apart: no row a pair, and components as by brute force."""
    import random

    r = random.Random(5)
    text = lambda at: " ".join(f"alt{k}" if k in at else f"word{k}" for k in range(200))
    main, far = range(10, 90, 5), range(100, 190, 5)
    edits = [set(), *({k} for k in main), *(set(r.sample(far, 5)) for _ in range(30))]
    paired, count = [], near_join._count

    def counted(pairs, segments):
        paired.append(pairs.count())
        return count(pairs, segments)

    monkeypatch.setattr(near_join, "_count", counted)
    df = spark.createDataFrame([(k, text(e)) for k, e in enumerate(edits)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_join.near_duplicates(df).collect()}
    sets = [set(zip(*(text(e).split()[k:] for k in range(5)))) for e in edits]
    want = list(range(len(edits)))
    for _ in edits:
        want = [min(want[j] for j in range(len(sets)) if 100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j])) for k in range(len(sets))]
    assert got == dict(enumerate(want)) and len(set(want)) > 3
    assert paired[1] < 100


def test_stragglers_meet_by_what_they_differ_by(spark):
    """Members that replace n-grams of their leader by others of the same buckets: only those that replace the same ones alike are paired,
    stragglers with members of the large component and with one another."""
    away, main, n = 20, 30, 100

    def member(b, k):
        new = {x: x + 4096 * b for x in range(b % 80, b % 80 + k)}
        return [new.get(x, x) for x in range(n)]

    tokens = {1: list(range(n))} | {b: member(b, 8) for b in range(2, main)} | {b: member(b, 15) for b in range(main, main + away)}
    tokens[70] = member(5, 15)  # with 5 it shares all that 5 replaces
    tokens[71] = member(40, 16)
    sets = spark.createDataFrame([(b, n, x) for b, x in tokens.items()], "doc_id long, n long, tokens array<long>")
    led = [(1, b, len(set(x) & set(tokens[1])), n, n, 1 if b < main else b) for b, x in tokens.items()]
    got = near_join._stragglers(spark.createDataFrame(led, "a long, b long, overlap long, n long, m long, component long"), sets, 80).collect()
    link = lambda x, y: 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})
    want = [(x, y) for x in tokens for y in tokens if 1 < x < y and y >= main and link(tokens[x], tokens[y])]
    assert sorted((min(r), max(r)) for r in got) == want == [(5, 70), (40, 71)]
