"""Filter audit, vector codes and packing against brute force, with odd inputs."""

import itertools
import random
import zlib
from math import factorial, inf, nan

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import filter_audit, packing, vector_codes

AUDITED = "doc_id long, text string, lang string, source string, n_chars long"


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filter_audit.plain_changes(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == factorial(n)


def test_walk_equals_recount():
    r = np.random.default_rng(4)
    counts = r.integers(0, 50, (3, 16, 3))
    names, steps, shapley = filter_audit.walk(counts, "WXYZ")
    assert sorted(names) == sorted("".join(p) for p in itertools.permutations("WXYZ"))
    total = np.zeros((3, 4), np.int64)
    for v, name in enumerate(names):
        before = 0
        for step, x in enumerate(name):
            f = "WXYZ".index(x)
            here = [m for m in range(16) if not m & before and m >> f & 1]
            before |= 1 << f
            assert (steps[v, step, :, 1:] == counts[:, here].sum(axis=1)).all()
            assert (steps[v, step, :, 0] == counts[:, [m for m in range(16) if not m & before], 0].sum(axis=1)).all()
            total[:, f] += counts[:, here, 0].sum(axis=1)
    assert (shapley == total).all()


@pytest.fixture(scope="module")
def audited(spark, odd):
    r = random.Random(8)
    words = lambda n, pool: " ".join(r.choice(pool) for _ in range(n))
    pool = [f"w{k}" for k in range(400)]
    texts = [words(300, pool), words(300, pool[:20]), words(250, pool).upper(), words(220, pool) + " #", "x y", words(300, pool) + "\x0b\x1c é"]
    rows = [(k if k % 11 else None, r.choice(texts) if k % 13 else None, r.choice(["en", "de", "", None]), "s", 1) for k in range(400)]
    docs = spark.createDataFrame([*rows, *rows[:20]], AUDITED).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000)).repartition(5)
    labels = spark.createDataFrame([(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 1030, 2)] + [(None, 1, 1), (4, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    return docs.withColumns({c: F.lit("x") for c in ("part", "mask", "words", "body", "n", "digest", "first", "good", "toxic", "quality")}), labels.withColumns({"text": F.lit("x"), "lang": F.lit("y"), "n": F.lit(1)})


def test_audit_equals_sql(audited, duck, rows_of):
    docs, labels = audited
    got = filter_audit.audit(docs, labels).toPandas()
    assert rows_of(got) == rows_of(duck(filter_audit.SQL, documents=docs, labels=labels)) and len(got) == 600 * 5


def test_audit_equals_brute_force(audited):
    """By Python alone: a document's words, copies, and what each order does to it."""
    docs, labels = (d.collect() for d in audited)
    smallest, marks = {}, {}
    for d in docs:
        if d.doc_id is not None:
            smallest[d.text or ""] = min(smallest.get(d.text or "", d.doc_id), d.doc_id)
    for x in labels:
        if x.doc_id is not None:
            marks[x.doc_id] = tuple(max(a, b == 1) for a, b in zip(marks.get(x.doc_id, (False, False)), (x.quality, x.toxic), strict=True))
    want = {}
    for d in docs:
        text = d.text or ""
        words = text.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text), "E": d.doc_id is not None and smallest[text] < d.doc_id}
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = next((k for k, f in enumerate(order) if fails[f]), 5)
            for k, f in enumerate(order):
                w = want.setdefault((d.lang or "", order, k + 1), [0] * 6)
                w[0] += k < gone
                w[1] += k == gone
                w[2] += fails[f] and gone < k
                w[3] += fails[f] and sum(fails.values()) == 1
                for place, mark in ((4, 0), (5, 1)):
                    w[place] += k == gone and bool(marks.get(d.doc_id, (0, 0))[mark])
    rows = filter_audit.audit(*audited).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in rows}
    assert got == want
    for r in rows[:50]:
        assert r.shapley == sum(w[1] for (part, order, step), w in want.items() if part == r.part and order[step - 1] == r.filter_order[r.step - 1])


def test_audit_of_nothing(spark, none, audited):
    docs, labels = audited
    assert filter_audit.audit(none, labels).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {(0, 0)}


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Codes by Python integers only."""
    from math import floor, isfinite

    kept = [r for r in rows if r[1] is not None and all(x is not None and isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = lambda v: [[floor(256 * x) for x in v[p * d : (p + 1) * d]] for p in range(parts)]
    x = [cut(r[1]) for r in kept]
    books = [[x[e][p] for e in range(min(entries, len(x)))] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for v in x:
            for p in range(parts):
                held[p][near(v[p], books[p])[1]].append(v[p])
        books = [[[sum(c) // len(c) for c in zip(*h, strict=True)] if h else old for h, old in zip(held[p], books[p], strict=True)] for p in range(parts)]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in x]
    return [(r[0], "".join(f"{e:02x}" for _, e in f), sum(far for far, _ in f), r[2]) for r, f in zip(kept, found, strict=True)], books


def vectors(n, width=32, seed=1):
    r = random.Random(seed)
    v = lambda: [float(np.float32(r.choice([r.gauss(0, 1), 0.0, 0.5, -0.25]))) for _ in range(width)]
    rows = [(k * 3 % (n + 2), v(), r.choice([1, 1, 1, 2, None])) for k in range(n)]
    odd = [(-1, None, 1), (-2, [nan] * width, 1), (-3, [inf] + [0.0] * (width - 1), 2), (-4, [None] * width, None), (None, v(), None), (None, v(), 3), rows[0], rows[1], (5, rows[2][1], 7), (5, v(), 7)]
    return rows + odd


@pytest.mark.parametrize(("n", "width"), [(300, 32), (20, 16), (90, 0)])
def test_codes_equal_brute_force(spark, n, width, duck, rows_of):
    rows = vectors(n, width) if width else [(k, [], 1) for k in range(n)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("id", "code", "error", "vector", "label_error", "part")}).repartition(4)
    got = vector_codes.compress(df).toPandas()
    want, books = brute_codes(rows)
    by_label = {}
    for _, _, error, label in want:
        by_label[label] = by_label.get(label, 0) + error
    import hashlib

    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    ids = [None if i != i else int(i) for i in got.vec_id]
    assert text(zip(ids, got.code, got.error, got.label_error, got.codebooks_sha256, strict=True)) == text((i, c, e, by_label[lab], digest) for i, c, e, lab in want)
    if width:
        known = lambda d: d.fillna({"vec_id": -99}).astype({"vec_id": "int64"})
        assert rows_of(known(got)) == rows_of(known(duck(vector_codes.SQL, embeddings=df)))


def test_codes_of_nothing_and_of_other_ids(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [nan] * 16, 1)], VECTORS)).count() == 0
    named = spark.createDataFrame([(f"v{k}", [float(k)] * 16, "a") for k in range(5)], "vec_id string, embedding array<double>, label string")
    assert {(r.vec_id, r.code, r.error) for r in vector_codes.compress(named).collect()} == {(f"v{k}", f"{k:02x}" * 16, 0) for k in range(5)}


def test_codes_refuse_what_they_cannot_do(spark):
    with pytest.raises(ValueError, match="one length"):
        vector_codes.train(spark.createDataFrame([(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], VECTORS))
    with pytest.raises(ArithmeticError):
        vector_codes.whole(np.array([[1e30] * 16]))


VOCABULARY = packing.default_vocabulary()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_words_have_the_tokenizers_ids(tokenizer, monkeypatch):
    r = random.Random(6)
    letters = "abcXYZ'éßΣσİŉ́ \n\t.,!?-_09²Ⅷ\x0b\x1c\x7f\x85\xa0　​中😀<|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(800)] + ["", " ", " a ", "\x0b", "x" * 3000, "<|endoftext|>b A<|endoftext|>", "don't WE'RE it's, a_b-c"]
    texts += [f"{chr(c)} a{chr(c)}B" for c in range(1, 0x250)]
    for kept in (packing.Tokens.KEPT, 50):
        monkeypatch.setattr(packing.Tokens, "KEPT", kept)
        t = packing.Tokens(VOCABULARY)
        assert t.plain
        for at in range(0, len(texts), 100):
            ids, ends = t.of(pa.array(texts[at : at + 100]))
            begin = 0
            for x, end in zip(texts[at : at + 100], ends.tolist(), strict=True):
                assert ids[begin:end].tolist() == [*tokenizer.encode(x, add_special_tokens=False).ids, packing.END], repr(x)
                begin = end
        assert all(len(w) <= packing.Tokens.LONGEST for w in t)


def least(places, costs, limit, elsewhere):
    """Cost of the best cuts by looking at every pair."""
    at, best = [0, *places], [0]
    for j in range(1, len(at)):
        pad = lambda n: 0 if n & (n - 1) == 0 else limit - n
        best.append(costs[j - 1] + min(best[i] + pad(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= limit))
    left = lambda i: at[-1] - at[i]
    return min(best[i] + min(pad(left(i)), (bin(left(i)).count("1") - 1) * elsewhere) for i in range(len(places)) if left(i) <= limit)


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_the_best(seed):
    r = np.random.default_rng(seed)
    limit = int(2 ** r.integers(3, 8))
    n = 1500
    ids = r.integers(0, 50, n).astype(np.uint32)
    doc_ends = np.unique(np.concatenate([r.integers(1, n, 40), [n]]))
    ends = np.zeros(50, bool)
    ends[: int(r.integers(0, 6))] = True
    costs = packing.Costs(1, int(r.integers(1, 20)), int(r.integers(20, 60)), limit, max(1, limit // 4))
    places, price = packing.cuts(ids, doc_ends, ends, costs)
    assert (np.diff(np.concatenate([[0], places])) > 0).all() and np.diff(np.concatenate([[0], places])).max() <= limit and set(doc_ends) <= set(places)
    cutter, cut, at = packing.Cutter(limit, costs.elsewhere), [], 0
    while at < len(places):  # fed in pieces, settled as it goes
        step = int(r.integers(1, 60))
        cut += cutter.add(places[at : at + step], price[at : at + step])
        at += step
    assert len(cutter.place) < len(places) + 1 or limit > 60
    cut += cutter.close()
    paid = dict(zip(places.tolist(), price.tolist(), strict=True))
    lengths = np.diff([0, *cut])
    assert cut[-1] == n and lengths.max() <= limit
    total = sum(paid.get(c, costs.elsewhere) for c in cut[:-1]) + sum(0 if k & (k - 1) == 0 else limit - k for k in lengths.tolist())
    assert total <= least(places.tolist(), price.tolist(), limit, costs.elsewhere) and any(c not in paid for c in cut) == (total < least(places.tolist(), price.tolist(), limit, 10**9))


@pytest.mark.parametrize("limit", [64, 4096])
def test_pieces_are_all_there(spark, odd, tokenizer, limit):
    costs = packing.Costs() if limit == 4096 else packing.Costs(gap=16, step=4)
    lone = odd.withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    given = lone.withColumns({c: F.lit("x") for c in ("start", "length", "ids_crc32", "sequence_id", "offset")}).repartition(3).cache()
    got = packing.pack(given, costs=costs, limit=limit).toPandas()
    sequences = got.sort_values("offset").groupby("sequence_id")
    for _, s in sequences:
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= limit
    want = []
    for d in given.collect():
        want.append((d.doc_id, [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, packing.END]))
    pieces = sorted((str(r.doc_id), r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got.astype({"doc_id": "Int64"}).itertuples())
    made = []
    known = {}
    for i, ids in want:
        known.setdefault((str(i) if i is not None else "<NA>", len(ids)), []).append(np.array(ids, "<u4"))
    assert sum(p[3] for p in pieces) == sum(len(ids) for _, ids in want)
    for i, n, start, length, crc in pieces:
        assert any(zlib.crc32(ids[start : start + length].tobytes()) == crc for ids in known[i, n])
        made.append((i, n, start))
    for (i, n), copies in known.items():
        mine = [p for p in pieces if p[:2] == (i, n)]
        covered = np.zeros(n, int)
        for p in mine:
            covered[p[2] : p[2] + p[3]] += 1
        assert (covered == len(copies)).all()
    padding = sum(0 if k & (k - 1) == 0 else limit - k for k in sequences.length.sum().tolist())
    assert padding <= 0.01 * got.length.sum()


def test_packing_of_nothing_and_of_other_ids(spark, none):
    assert packing.pack(none).count() == 0
    rows = packing.pack(spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string").coalesce(1)).collect()
    assert [(r.doc_id, r.length, r.doc_tokens, r.offset) for r in rows] == [("a", 1, 1, 0), ("b", 1, 1, 1)] and len({r.sequence_id for r in rows}) == 1
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(none, limit=1000)
