"""Benchmark decontamination by one Aho-Corasick automaton.

Windows of consecutive words of all items, between spaces, are the automaton's patterns; a text is normalised once, scanned once,
and hits are mapped back to words and, where asked for, to offsets in the original text. Benchmarks above ``BLOCK_CHARS``
characters are scanned in blocks of items, one automaton each, so that what is broadcast has a fixed bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.shipping import ship

WINDOW = 10
BLOCK_CHARS = 4_000_000

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, with A-Z lower-cased."""
    return text.encode().translate(_NORMAL).split() if text else []


def windows(items: list[tuple[str, str | None]], size: int = WINDOW) -> dict[bytes, set[str]]:
    """Windows of ``size`` words, with the items that have them; an item of fewer words, but some, is one window."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(b" ".join(w[k : k + size]), set()).add(item)
    return found


class Scanner:
    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW) -> None:
        self.automaton = ahocorasick.Automaton()
        for w, owners in windows(items, size).items():
            self.automaton.add_word(f" {w.decode('latin-1')} ", (len(w), w.count(b" ") + 1, tuple(owners)))
        self.automaton.make_automaton()

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that are hit, each once, and the items that hit."""
        if not w or not len(self.automaton):
            return [], set()
        text = f" {b' '.join(w).decode('latin-1')} "  # a byte a character, so that offsets are those of the bytes
        hits: dict[int, int] = {}
        items: set[str] = set()
        for end, (_, n, owners) in self.automaton.iter(text):
            if hits.get(end, 0) < n:
                hits[end] = n
            items.update(owners)
        if not hits:
            return [], items
        ends = np.cumsum([len(x) + 1 for x in w])  # of the space after each word
        last = np.searchsorted(ends, list(hits)) + 1
        return sorted({(int(e) - n, int(e)) for e, n in zip(last, hits.values(), strict=True)}), items


_scanners: dict[tuple, Scanner] = {}


def _scanner(items: list[tuple[str, str | None]], key: tuple, size: int) -> Scanner:
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(items, size)
    return _scanners[key]


def _scan(block, key: tuple, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(block.value, key, size)
        for b in batches:
            n, hit, items = [], [], []
            for text, old, had in zip(b.column("__text").to_pylist(), b.column("__hit").to_pylist(), b.column("__items").to_pylist(), strict=True):
                ranges, own = scanner.scan(w := words(text))
                n.append(len(w))
                hit.append(old + np.array(ranges, np.int64).tobytes())
                items.append(sorted({*had, *own}))
            new = {"__n": pa.array(n, pa.int64()), "__hit": pa.array(hit, pa.binary()), "__items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], b.schema.names)

    return run


def _merged(hit: bytes) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted(map(tuple, np.frombuffer(hit, np.int64).reshape(-1, 2).tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, n_hit, digest = [], [], []
        for text, hit, items in zip(b.column("__text").to_pylist(), b.column("__hit").to_pylist(), b.column("__items").to_pylist(), strict=True):
            ranges = _merged(hit)
            at = [m.span() for m in _WORD.finditer(text)] if ranges else []
            spans.append([{"start": at[a][0], "end": at[e - 1][1]} for a, e in ranges])
            n_hit.append(sum(e - a for a, e in ranges))
            digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__n"), pa.array(n_hit, pa.int64()), b.column("__items"), pa.array(digest, pa.string()), pa.array(spans, span)], ["doc_id", "n_words", "n_hit", "items", "items_sha256", "spans"])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items streamed to the driver, at most a block of them (and one item more) at a time; one empty block if there are none."""
    block, held, first = [], 0, True
    for item, text in benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        block.append((item, text))
        held += len(text)
        if held >= block_chars:
            yield block
            block, held, first = [], 0, False
    if block or first:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit (words inside an occurrence of a window), items (whose windows occur, sorted as strings),
    items_sha256, spans (runs of hit words as code point offsets of the original text, end exclusive), contaminated.

    Null and empty texts have no words. Items without id, text or words are void; items that repeat count once. Rows that repeat
    are reported each. An empty benchmark hits nothing. Other columns are not read.
    """
    sc = ship(docs.sparkSession).sparkContext
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), F.lit(0).cast("long").alias("__n"), F.lit(b"").alias("__hit"), F.array().cast("array<string>").alias("__items"))
    schema = out.schema
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):  # the driver keeps none of them
        key = (window, hashlib.sha256(repr(block).encode()).hexdigest())
        out = out.mapInArrow(_scan(sc.broadcast(block), key, window), schema)
    kind = dict(docs.dtypes)[id_col]
    out = out.mapInArrow(_report, f"doc_id {kind}, n_words long, n_hit long, items array<string>, items_sha256 string, spans array<struct<start:long,end:long>>")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _keep(block, key: tuple, size: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(block.value, key, size)
        for b in batches:
            yield b.filter(pa.array([not scanner.scan(words(t))[0] for t in b.column(text_col).to_pylist()], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without any occurrence of a window, with all columns; one pass for each block of items. Nulls as in ``contamination``."""
    sc = ship(docs.sparkSession).sparkContext
    out = docs
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        key = (window, hashlib.sha256(repr(block).encode()).hexdigest())
        out = out.mapInArrow(_keep(sc.broadcast(block), key, window, text_col), docs.schema)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"))


#: A word of a lower-cased text in RE2, as ``words`` finds it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sql(documents: str = "documents", columns: str = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans", before: str = "", window: int = WINDOW) -> str:
    lower = lambda c: f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words_of = lambda c: f"regexp_extract_all({lower(c)}, '{WORD}')"
    return rf"""
WITH {before} dw AS (SELECT doc_id, text, {words_of("text")} AS w FROM {documents}),
bw AS (SELECT item_id, {words_of("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS k, array_to_string(w[i:i + {window - 1}], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), dg AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hits AS MATERIALIZED (SELECT doc_id, i, dg.k, item_id FROM dg JOIN win USING (k, g)),
hw AS MATERIALIZED (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits)),
h AS (SELECT doc_id, count(*) AS n_hit FROM hw GROUP BY doc_id),
gaps AS (SELECT doc_id, w, regexp_split_to_array({lower("text")}, '{WORD}') AS g FROM dw WHERE doc_id IN (SELECT doc_id FROM h)),
lens AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(list_transform(w, lambda x: length(x))) AS n, unnest(list_transform(g[1:len(w)], lambda x: length(x))) AS gap FROM gaps),
ends AS (SELECT doc_id, p, n, (sum(gap + n) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM lens),
runs AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hw),
sp AS (
  SELECT doc_id, string_agg(a || ':' || e, ',' ORDER BY a) AS spans
  FROM (SELECT doc_id, min(stop - n) AS a, max(stop) AS e FROM runs JOIN ends USING (doc_id, p) GROUP BY doc_id, run) GROUP BY doc_id
),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
  FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN sp USING (doc_id) LEFT JOIN it USING (doc_id)
)
SELECT {columns} FROM found
"""


SQL = sql()
