import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import decontaminate, line_dedup, mixing, near_join
from tidewatch.llm.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        path = f"{data}/sf0.001/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'' if os.path.isfile(path) else '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, db, rows_of, name):
    got = QUERIES[name](spark, f"{data}/sf0.001").toPandas()
    table = "pages" if name.startswith(("op2_", "op5_")) else "embeddings" if name.startswith("op12_") else "documents"
    if not name.startswith(("op11_", "op13_")):
        assert len(got) == db.sql(f"SELECT count(*) AS n FROM {table}").df()["n"].item()
    if name in ORACLE_SQL:
        assert rows_of(got) == rows_of(db.sql(ORACLE_SQL[name]).df())


def test_stages(spark, data, rows_of):
    """Each stage but the first against DuckDB on the rows that it was given."""
    sf = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c = duckdb.connect()
    c.register("benchmark", spark.read.parquet(f"{sf}/benchmark.parquet").toArrow())
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).persist()
        c.register("given", docs.toArrow())
        got = out.toPandas()
        seen.append(len(got))
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "quality":
            kept = {r.doc_id for r in out.collect()}
            lab = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
            assert all(i in kept for i in lab.index[lab == 1]) and 0 < len(kept) < docs.count()
        elif name == "line dedup":
            want = c.sql(line_dedup.sql("given", "doc_id, array_to_string(rest, chr(10)) AS text")).df()
            assert rows_of(got[["doc_id", "text"]]) == rows_of(want) and (got.n_chars == got.text.str.len()).all()
        elif name == "near duplicates":
            want = c.sql(f"SELECT doc_id FROM ({near_join.sql('given', 5, 80)}) WHERE doc_id = component_id").df()
            assert sorted(got.doc_id) == sorted(want.doc_id)
        elif name == "decontamination":
            want = c.sql(f"SELECT doc_id FROM ({decontaminate.sql('given')}) WHERE NOT contaminated").df()
            assert sorted(got.doc_id) == sorted(want.doc_id)
        else:
            from tidewatch.llm import mixing

            want = c.sql(f"SELECT doc_id, taken FROM ({mixing.sql('given')}) WHERE taken > 0").df()
            assert rows_of(got[["doc_id", "taken"]]) == rows_of(want)
        docs = spark.createDataFrame(out.toArrow())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3]
    whole = corpus_pipeline.run(spark, sf).select("doc_id", "taken").toPandas()
    assert rows_of(whole) == rows_of(got[["doc_id", "taken"]])


def test_copies_keep_their_lines(spark):
    """A third of a source are copies: one stays, with its text; a line of many different pages goes."""
    own = lambda k: "\n".join(" ".join(f"{w}{k}" for w in line.split()) for line in ("one two three four five six seven", "eight nine ten eleven twelve"))
    rows = [(k, f"{own(k if k < 40 else 40)}\n{'Footer' if k % 2 else ''}\n", "en", "s", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = corpus_pipeline.without_boilerplate(spark, docs, "").persist()
    assert {r.doc_id: r.text.strip() for r in out.collect()} == {k: own(min(k, 40)) for k in range(60)}
    last = corpus_pipeline.mixed(spark, corpus_pipeline.one_of_each(spark, out, ""), "").collect()
    assert {r.doc_id for r in last} == set(range(41))


def test_documents_without_an_id_come_out(spark, data):
    """All stages after the first; the words of each source that come out are its target."""
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(None if k % 3 == 0 else k, words(k, 20 + k % 2), f"l{k}", "ab"[k % 2], 1) for k in range(40)] + [(None, None, None, "a", 0), (None, words(99, 8), "x", None, 1), (None, words(99, 8), "y", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for _, stage in corpus_pipeline.STAGES[1:]:
        given, docs = docs, stage(spark, docs, f"{data}/sf0.001")
    goal = {r.source: r.words for r in mixing.mix(given, carry=F.struct("source")).selectExpr("carried.source", "taken").groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    out = docs.collect()
    assert {s: sum(r.taken for r in out if r.source == s) for s in goal} == goal and docs.columns == [*given.columns, "n_words", "taken"]
    texts = {r[2]: r for r in rows}
    assert any(r.doc_id is None for r in out) and len({r.lang for r in out}) == len(out)
    assert all((r.doc_id, r.text, r.source) == (texts[r.lang][0], texts[r.lang][1], texts[r.lang][3]) and r.n_words == len(r.text.split()) for r in out)


def test_entry():
    import __spark_entry__ as e

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near duplicates", "decontamination", "mixing"]
    names = set(e.queries())
    assert {"pipeline", *QUERIES} <= names and set(e.oracle_sql()) <= names and "pipeline" not in e.oracle_sql()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
