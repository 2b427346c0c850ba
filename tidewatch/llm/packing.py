"""Packing documents into sequences of bounded length without reordering them.

The documents of a task are one stream of token ids. A cut may be made after a document (nearly free), after a sentence, or, where
neither is near, at every so many ids, each with its own penalty. Dynamic programming picks the cuts of least padding and penalties:
the cost of a window ends up as a term of its start plus one of its end, so the best start within reach is the head of a monotone
queue, and the few windows whose length is a power of two, which need no padding, are looked up besides.

The stream is never held whole: whenever the best ways to all cuts still in reach have a cut in common, what is before it is settled
and given out. So the result is the optimum of the task's stream, in memory of a few windows. Tasks pack apart, and
the last ids of each may be cut into powers of two anywhere; nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.shipping import ship

LIMIT = 4096
END = 2  # the id that closes a document


@dataclass(frozen=True)
class Costs:
    """Penalties of a cut, in tokens of padding: after a document, after a sentence, elsewhere. The first is above nothing so that of
    two equal ways the one of fewer sequences is taken. ``gap`` ids without a cut are cut at every ``step``-th."""

    document: int = 1
    sentence: int = 32
    elsewhere: int = 128
    gap: int = 256
    step: int = 64


class Tokens(dict):
    """Ids (as 32-bit little-endian bytes) of words, runs of bytes between ASCII white space, as the tokenizer at ``path`` gives them.

    The tokenizer drops white space and no token of it spans any, so a text's ids are those of its words in a row: each distinct word of
    a batch is looked up once, and only new ones are split. Those of ASCII and composed Latin letters are put in lower case and cut by
    the tokenizer's own pattern, and the tokenizer's model splits the new pieces, all in one call. All other words, and any that may hold a
    special token, go through the whole tokenizer. At most about ``KEPT`` words of up to ``LONGEST`` characters are remembered.
    """

    KEPT, LONGEST = 700_000, 64

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.pieces.normalizer, self.pieces.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.plain = _plain(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last, self.sentence_ends = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        for token, i in vocabulary.items():
            mark = token.removesuffix("</w>")
            self.last[i] = mark != token
            self.sentence_ends[i] = mark != token and mark != "" and not mark.strip(".!?")

    def learn(self, words: list[str]) -> None:
        """Take in the words that are not known yet."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.KEPT:
            self.clear()
            new = words
        if not new:
            return
        odd = pc.match_substring_regex(pa.array(new), _ODD).to_numpy(zero_copy_only=False) if self.plain else np.ones(len(new), bool)
        for k in np.flatnonzero(odd).tolist():
            self[new[k]] = np.array(self.tokenizer.encode(new[k], add_special_tokens=False).ids, "<u4").tobytes()
        latin = [new[k] for k in np.flatnonzero(~odd).tolist()] if odd.any() else new
        lower = "\n".join(latin).lower().split("\n") if latin else []
        todo = {w for w in lower if w not in self}
        cut = {w: _PIECE.findall(w) for w in todo if not w.isalpha()}
        fresh = [p for p in todo.difference(cut).union(*cut.values()) if p not in self]
        if fresh:
            spelt = " ".join([p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES) for p in fresh])
            ids = np.array(self.pieces.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u4")
            raw, begin = ids.tobytes(), 0
            for p, end in zip(fresh, (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist(), strict=True):
                self[p] = raw[begin:end]
                begin = end
        for w, p in cut.items():
            self[w] = b"".join([self[x] for x in p])
        for w, low in zip(latin, lower, strict=True):
            if w != low:
                self[w] = self[low]

    def forget_long(self, words: list[str]) -> None:
        for w in words:
            if len(w) > self.LONGEST:
                self.pop(w, None)

    def of(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the one that closes it, and where each ends."""
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(each.dictionary)], each.dictionary)
        distinct = pc.binary_join(distinct, "\n")[0].as_py().split("\n") if len(each.dictionary) else []
        self.learn(distinct)
        known = list(map(self.__getitem__, distinct))
        self.forget_long(distinct)
        length = np.array(list(map(len, known)), np.int64) // 4
        begin, ids = length.cumsum() - length, np.frombuffer(b"".join(known), "<u4")
        word = each.indices.to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], length[word].cumsum()])
        at = np.repeat(begin[word] - upto[:-1], length[word]) + np.arange(upto[-1])
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        ends = upto[bounds[1:]] + np.arange(1, len(texts) + 1)
        out = np.full(upto[-1] + len(texts), END, np.uint32)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = ids[at]
        return out, ends


_known: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One table of words a Python worker, for all tasks that it runs."""
    if path not in _known:
        _known[path] = Tokens(path)
    return _known[path]


#: The pattern by which the word tokenizer cuts text, and its characters for bytes above ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {b: (b if 161 <= b <= 172 or 174 <= b <= 255 else 256 + 33 + b - 127 if b < 161 else 256 + 67) for b in range(127, 256)}
#: Letters of the Latin blocks that have one lower-case letter each and are composed already.
_LETTERS = "À-ÖØ-öø-įı-ňŊ-ſ"
_ODD = f"[^!-~{_LETTERS}]|<[|]"
_PIECE = re.compile(PATTERN.replace(r"[\p{L}]", f"[a-z{_LETTERS}]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", f"a-z0-9{_LETTERS}"))


def _plain(path: str) -> bool:
    """Whether the tokenizer treats ASCII as ``Tokens`` does by itself: lower case, that pattern, bytes as they are."""
    t = json.loads(Path(path).read_text())
    steps = (t.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = steps[0].get("pattern", {}).get("Regex") if steps and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" else None
    known = [x.get("type") for x in (t.get("normalizer") or {}).get("normalizers") or []] == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
    marked = all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] for x in t.get("added_tokens") or [])
    return known and split == PATTERN and marked and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")


def cuts(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Places (number of ids before) where the ids of whole documents may be cut, ascending, and what each costs."""
    is_end = ends[ids]
    at_doc = np.zeros(len(ids), bool)
    at_doc[doc_ends - 1] = True
    place = np.flatnonzero(is_end | at_doc) + 1
    cost = np.where(at_doc[place - 1], costs.document, costs.sentence)
    before = np.concatenate([[0], place[:-1]])
    extra = np.where(place - before > costs.gap, (place - before - 1) // costs.step, 0)
    if extra.any():
        nth = np.arange(extra.sum()) - np.repeat(extra.cumsum() - extra, extra) + 1
        more = np.repeat(before, extra) + nth * costs.step
        place, cost = np.concatenate([place, more]), np.concatenate([cost, np.full(len(more), costs.elsewhere)])
        order = place.argsort(kind="stable")
        place, cost = place[order], cost[order]
    return place, cost


class Cutter:
    """The cheapest cuts of a stream, as its places come in. ``add`` and ``close`` return cuts that are settled, in order."""

    def __init__(self, limit: int = LIMIT, elsewhere: int = Costs.elsewhere) -> None:
        self.limit, self.elsewhere = limit, elsewhere
        self.powers = [1 << k for k in range(limit.bit_length()) if 1 << k < limit]
        self.place, self.cost, self.parent = [0], [0], [-1]  # of the open places; the first is settled
        self.queue: deque[int] = deque([0])

    def _whole(self, new: np.ndarray) -> tuple[list[int], list[int]]:
        """Pairs (new place, earlier place) that are a power of two below the limit apart: for each new place from where its
        earlier ones begin, and these."""
        old = np.array(self.place, np.int64)
        at = np.concatenate([old, new])
        low = int(at[0])
        slot = np.full(int(at[-1]) - low + 1, -1, np.int32)
        slot[at - low] = np.arange(len(at))
        here, there = [], []
        for p in self.powers:
            back = new - p - low
            found = np.where(back >= 0, slot[np.maximum(back, 0)], -1)
            hit = np.flatnonzero(found >= 0)
            here.append(hit)
            there.append(found[hit])
        h, t = np.concatenate(here), np.concatenate(there)
        order = h.argsort(kind="stable")
        begin = np.concatenate([[0], np.bincount(h, minlength=len(new)).cumsum()])
        return begin.tolist(), t[order].tolist()

    def add(self, places: np.ndarray, costs: np.ndarray) -> list[int]:
        if not len(places):
            return []
        begin, earlier = self._whole(places)
        place, cost, parent, queue, limit = self.place, self.cost, self.parent, self.queue, self.limit
        k = len(place)
        for p, penalty, a, b in zip(places.tolist(), costs.tolist(), begin, begin[1:], strict=False):
            while place[queue[0]] < p - limit:
                queue.popleft()
            best = queue[0]
            least = cost[best] + place[best] + limit - p
            if a < b:
                for e in earlier[a:b]:
                    if cost[e] < least:
                        best, least = e, cost[e]
            least += penalty
            place.append(p)
            cost.append(least)
            parent.append(best)
            key = least + p
            while queue and cost[queue[-1]] + place[queue[-1]] > key:
                queue.pop()
            queue.append(k)
            k += 1
        return self._settle()

    def _way(self, to: int) -> list[int]:
        out = []
        while to > 0:
            out.append(self.place[to])
            to = self.parent[to]
        return out[::-1]

    def _settle(self) -> list[int]:
        """Cuts that are on the best way to every place still in reach; what is before them is forgotten."""
        last = self.place[-1]
        open_ = [-k for k in range(len(self.place) - 1, -1, -1) if self.place[k] >= last - self.limit]
        seen = set(open_)
        heapq.heapify(open_)
        while len(open_) > 1:
            up = -self.parent[-heapq.heappop(open_)]
            if up not in seen:
                seen.add(up)
                heapq.heappush(open_, up)
        root = -open_[0]
        if root <= 0:
            return []
        out = self._way(root)
        self.place, self.cost = self.place[root:], self.cost[root:]
        self.parent = [p - root for p in self.parent[root:]]
        self.queue = deque(q - root for q in self.queue if q >= root)
        return out

    def close(self) -> list[int]:
        """The rest. What is left at the end of a stream may be cut anywhere into powers of two, if that is cheaper than padding it."""
        end, n = self.place[-1], len(self.place) - 1
        if not n:
            return []
        price = lambda left: min((left.bit_count() - 1) * self.elsewhere, self.limit - left)
        last = min((k for k in range(n) if end - self.place[k] <= self.limit), key=lambda k: self.cost[k] + price(end - self.place[k]))
        out, at = self._way(last), self.place[last]
        if (end - at).bit_count() > 1 and price(end - at) < self.limit - (end - at):
            for p in reversed([1 << k for k in range(self.limit.bit_length()) if (end - at) >> k & 1]):
                at += p
                out.append(at)
            return out
        return [*out, end]


class Stream:
    """Documents in, pieces out: (document, start, length, CRC-32, ids of the document, sequence, offset)."""

    def __init__(self, first_sequence: int, ends: np.ndarray, costs: Costs = Costs(), limit: int = LIMIT) -> None:
        self.sequence, self.ends, self.costs = first_sequence, ends, costs
        self.cutter = Cutter(limit, costs.elsewhere)
        self.docs: deque[tuple[object, int, np.ndarray]] = deque()  # those with ids not yet given out
        self.total = self.done = 0

    def add(self, docs: list, ids: np.ndarray, doc_ends: np.ndarray) -> Iterator[tuple]:
        """``ids`` of all ``docs`` in a row, each up to its end."""
        if not docs:
            return
        place, cost = cuts(ids, doc_ends, self.ends, self.costs)
        start = 0
        for doc, end in zip(docs, doc_ends.tolist(), strict=True):
            self.docs.append((doc, self.total + start, ids[start:end]))
            start = end
        place += self.total
        self.total += start
        yield from self._pieces(self.cutter.add(place, cost))

    def close(self) -> Iterator[tuple]:
        yield from self._pieces(self.cutter.close())

    def _pieces(self, settled: Iterable[int]) -> Iterator[tuple]:
        for cut in settled:
            begin = self.done
            while self.done < cut:
                doc, start, ids = self.docs[0]
                at, to = self.done - start, min(len(ids), cut - start)
                yield doc, at, to - at, zlib.crc32(ids[at:to].tobytes()), len(ids), self.sequence, self.done - begin
                self.done = start + to
                if to == len(ids):
                    self.docs.popleft()
            self.sequence += 1


def _packing(path: str, costs: Costs, limit: int, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        stream = Stream(TaskContext.get().partitionId() << 40, tokens.sentence_ends, costs, limit)
        types = to_arrow_schema(schema)

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), types.types, strict=True)], schema=types)

        for b in batches:
            ids, ends = tokens.of(pc.fill_null(b.column("text"), ""))
            if pieces := list(stream.add(b.column("doc_id").to_pylist(), ids, ends)):
                yield table(pieces)
        if pieces := list(stream.close()):
            yield table(pieces)

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, vocabulary: str | None = None, costs: Costs = Costs(), limit: int = LIMIT) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents stay in the order in which the table is read, repeated rows and null ids are documents of their own, and the ids of each
    are those of its whole text and id 2; null and empty texts have that id only. A sequence has up to ``limit`` ids; one that is
    shorter is padded to it unless its length is a power of two. Where a file is split decides which documents share a task, so
    other splits may give other cuts; the same splits give the same. An empty table gives no rows; other columns are not read.
    """
    spark = ship(docs.sparkSession)
    if limit < 1 or limit & (limit - 1):
        raise ValueError("the limit must be a power of two")
    if costs.gap > limit or costs.step > costs.gap:
        raise ValueError("cuts must be within reach of one another")
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    long_ = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([d.schema["doc_id"], *long_])
    return d.mapInArrow(_packing(vocabulary or default_vocabulary(), costs, limit, schema), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
