"""A tamper-evident trail: hash chain, Merkle roots, signed checkpoints, and a check of them that runs in parallel."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.operators.windows import numbered
from tidewatch.shipping import ship

ENTRY_DOMAIN, CHECKPOINT_DOMAIN = "tidewatch.audit.entry.v1", "tidewatch.audit.checkpoint.v1"
GENESIS = "00" * 32
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def _be(x: Column, size: int) -> Column:
    """Big-endian bytes of an integer that isn't negative."""
    return F.unhex(F.lpad(F.hex(x), 2 * size, "0"))


def entry_hash(seq: Column, ts_ns: Column, payload: Column, prev: Column) -> Column:
    data = payload.cast("binary")
    return F.sha2(F.concat(F.lit(ENTRY_DOMAIN).cast("binary"), _be(seq, 8), _be(ts_ns, 8), _be(F.octet_length(data), 4), data, F.unhex(prev)), 256)


def hash_entry(seq: int, ts_ns: int, payload: bytes, prev: str) -> str:
    head = ENTRY_DOMAIN.encode() + seq.to_bytes(8, "big") + ts_ns.to_bytes(8, "big") + len(payload).to_bytes(4, "big")
    return hashlib.sha256(head + payload + bytes.fromhex(prev)).hexdigest()


def merkle_root(hashes: list[str]) -> str:
    """Root over entry hashes: leaves and nodes have prefixes of their own, an odd node goes up as it is."""
    level = [hashlib.sha256(b"\x00" + bytes.fromhex(h)).digest() for h in hashes]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + level[k] + level[k + 1]).digest() for k in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0].hex() if level else EMPTY_ROOT


class Peaks:
    """The root over entries as they come, from the roots of complete subtrees alone: as many as the count has binary ones.

    ``add`` takes an entry's hash, or the root of a complete subtree of ``2**height`` entries where so many fit.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[int, bytes]] = []
        self.count = 0

    def add(self, entry: str) -> None:
        self.join(0, hashlib.sha256(b"\x00" + bytes.fromhex(entry)).digest())

    def join(self, height: int, node: bytes) -> None:
        if self.count & ((1 << height) - 1):
            raise ValueError("a subtree must follow on complete ones of its size")
        self.count += 1 << height
        while self.stack and self.stack[-1][0] == height:
            node = hashlib.sha256(b"\x01" + self.stack.pop()[1] + node).digest()
            height += 1
        self.stack.append((height, node))

    def root(self) -> str:
        """The same as ``merkle_root`` of all entries."""
        if not self.stack:
            return EMPTY_ROOT
        node = self.stack[-1][1]
        for _, left in reversed(self.stack[:-1]):
            node = hashlib.sha256(b"\x01" + left + node).digest()
        return node.hex()


def checkpoint_message(first: int, last: int, root: str) -> bytes:
    return CHECKPOINT_DOMAIN.encode() + first.to_bytes(8, "big") + last.to_bytes(8, "big") + bytes.fromhex(root)


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    prev = GENESIS
    for b in batches:
        rows = []
        for seq, ts, payload in b[["seq", "ts_ns", "payload"]].itertuples(index=False):
            h = hash_entry(int(seq), int(ts), payload.encode(), prev)
            rows.append((int(seq), int(ts), payload, prev, h))
            prev = h
        yield pd.DataFrame(rows, columns=["seq", "ts_ns", "payload", "prev_hash", "hash"])


def chain(entries: DataFrame) -> DataFrame:
    """(ts_ns, payload, n) -> seq, ts_ns, payload, prev_hash, hash. A chain is sequential by nature: one task streams through it in
    order and holds one batch; only throttled alerts come this way."""
    ship(entries.sparkSession)
    e = entries.select(F.col("n").alias("seq"), "ts_ns", "payload").repartition(1).sortWithinPartitions("seq")
    return e.mapInPandas(_chained, "seq bigint, ts_ns bigint, payload string, prev_hash string, hash string")


def payloads(alerts: DataFrame) -> DataFrame:
    """Alerts as entries of a chain; the payload is kept word for word as it was hashed."""
    shown = [c for c in ("id", "ts_ns", "detector", "symbol", "severity", "severity_label", "score", "description", "detect_latency_us") if c in alerts.columns]
    body = F.to_json(F.struct(*shown, *([F.from_json("evidence", "map<string,string>").alias("evidence")] if "evidence" in alerts.columns else [])))
    return alerts.select("n", "ts_ns", body.alias("payload"))


def chain_faults(trail: DataFrame) -> DataFrame:
    """Entries that fail: at (their place), seq, reason. Each is checked against the entry before it only, so all run in parallel;
    the trail holds exactly if there is none, and the fault at the first place is the one that a walk would meet."""
    t = trail if "at" in trail.columns else trail.withColumn("at", F.col("seq"))
    t = numbered(t, ["at"], F.floor(F.col("at") / 100_000), "expected")
    ends = t.withColumn("part", F.floor(F.col("expected") / 100_000))
    edge = ends.groupBy("part").agg(F.max_by("hash", "expected").alias("edge_hash")).select((F.col("part") + 1).alias("part"), "edge_hash")
    t = ends.withColumn("near", F.lag("hash").over(W.partitionBy("part").orderBy("expected"))).join(edge, "part", "left")
    before = F.when(F.col("expected") == 1, F.lit(GENESIS)).otherwise(F.coalesce("near", "edge_hash"))
    whole = lambda c: F.coalesce(F.lower(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    got = entry_hash(F.col("seq"), F.col("ts_ns"), F.col("payload"), F.lower("prev_hash"))
    reason = (
        F.when(F.col("seq").isNull() | (F.col("seq") != F.col("expected")), "sequence break")
        .when(~whole("prev_hash"), "malformed prev_hash")
        .when(F.lower("prev_hash") != F.lower(before), "broken chain link")
        .when(~whole("hash"), "malformed hash")
        .when(got != F.lower("hash"), "hash mismatch")
    )
    return t.select("at", "seq", reason.alias("reason")).where("reason IS NOT NULL")


BLOCK = 1 << 12  # entries whose subtrees are made apart


def _by_group(keys: list[str], read: list[str], end: Callable[[Iterator[tuple]], tuple], ddl: str):
    """Rows that come sorted by ``keys`` -> one row a group, its key and what ``end`` makes of its rows as they stream by: a call for each
    group costs far more than a small group itself, and gathering one would cost its size."""
    schema = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, out = to_arrow_schema(schema), []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in (*keys, *read)), strict=True))
        for key, group in groupby(rows, lambda row: row[: len(keys)]):
            out.append((*key, *end(row[len(keys) :] for row in group)))
            if len(out) == 1000:
                yield made()
                out = []
        if out:
            yield made()

    return run


def _grouped(rows: DataFrame, keys: list[str], read: list[str], end: Callable[[Iterator[tuple]], tuple], ddl: str) -> DataFrame:
    """One row for each of ``keys``, from its rows in the order of the first column of ``read``."""
    ship(rows.sparkSession)
    dealt = rows.select(*keys, *read).repartition(*keys).sortWithinPartitions(*keys, read[0])
    ddl = ", ".join([*(f"{c} bigint" for c in keys), ddl])
    return dealt.mapInArrow(_by_group(keys, read, end, ddl), ddl)


def _subtrees(rows: Iterator[tuple]) -> tuple:
    p, first, last = Peaks(), None, None
    for last, h in rows:
        first = last if first is None else first
        p.add(h)
    return first, last, p.count, [h for h, _ in p.stack], [x for _, x in p.stack]


def _roots(rows: Iterator[tuple]) -> tuple:
    p, first, last = Peaks(), None, None
    for _, start, last, heights, nodes in rows:
        first = start if first is None else first
        for h, node in zip(heights, nodes, strict=True):
            p.join(h, node)
    return first, last, p.count, p.root()


def merkle_roots(trail: DataFrame, interval: int) -> DataFrame:
    """Root of each ``interval`` entries and of the rest: from_seq, to_seq, n, merkle_root.

    Subtrees of ``BLOCK`` entries are made apart, and an interval's root from these, so an interval of any length is spread over tasks.
    """
    at = F.col("seq") - 1
    t = trail.select("seq", "hash", F.floor(at / interval).cast("bigint").alias("k"), F.floor((at % interval) / BLOCK).cast("bigint").alias("block"))
    t = _grouped(t, ["k", "block"], ["seq", "hash"], _subtrees, "from_seq bigint, to_seq bigint, n bigint, heights array<int>, nodes array<binary>")
    t = _grouped(t, ["k"], ["block", "from_seq", "to_seq", "heights", "nodes"], _roots, "from_seq bigint, to_seq bigint, n bigint, merkle_root string")
    return t.drop("k")


class Signer:
    """Ed25519 by the JVM. The key is made from a seed of 32 bytes, kept as hexadecimal in a file only its owner can read."""

    _SPKI = bytes.fromhex("302a300506032b6570032100")
    _PKCS8 = bytes.fromhex("302e020100300506032b657004220420")

    def __init__(self, spark: SparkSession, seed: bytes, public: bytes | None = None) -> None:
        self._jvm = spark._jvm
        self.seed = seed
        security = self._jvm.java.security
        self._key = security.KeyFactory.getInstance("Ed25519").generatePrivate(security.spec.PKCS8EncodedKeySpec(self._PKCS8 + seed))
        if public is None:
            rng = _seeded(self._jvm, seed)
            public = bytes(x & 255 for x in rng)
        self.public = public

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Signer:
        """The key in a file, made if there is none."""
        p = Path(path)
        if not p.exists():
            p.parent.mkdir(parents=True, exist_ok=True)
            with os.fdopen(os.open(p, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
                f.write(os.urandom(32).hex())
        seed = bytes.fromhex(p.read_text().strip())
        if len(seed) != 32:
            raise ValueError(f"{path} holds no key")
        return cls(spark, seed)

    def sign(self, message: bytes) -> str:
        s = self._jvm.java.security.Signature.getInstance("Ed25519")
        s.initSign(self._key)
        s.update(message)
        return bytes(x & 255 for x in s.sign()).hex()

    @classmethod
    def verify(cls, spark: SparkSession, public: str, message: bytes, signature: str) -> bool:
        try:
            security = spark._jvm.java.security
            key = security.KeyFactory.getInstance("Ed25519").generatePublic(security.spec.X509EncodedKeySpec(cls._SPKI + bytes.fromhex(public)))
            s = security.Signature.getInstance("Ed25519")
            s.initVerify(key)
            s.update(message)
            return bool(s.verify(bytes.fromhex(signature)))
        except Exception as e:  # the JVM's refusals of malformed keys and signatures
            if "Py4J" in type(e).__name__ or isinstance(e, ValueError):
                return False
            raise


_P = 2**255 - 19
_D = -121665 * pow(121666, -1, _P) % _P
_BY = 4 * pow(5, -1, _P) % _P


def _root(y: int) -> int:
    xx = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(xx, (_P + 3) // 8, _P)
    if (x * x - xx) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    return _P - x if x % 2 else x


def _add(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    (x1, y1), (x2, y2) = a, b
    k = _D * x1 * x2 * y1 * y2 % _P
    return (x1 * y2 + x2 * y1) * pow(1 + k, -1, _P) % _P, (y1 * y2 + x1 * x2) * pow(1 - k, -1, _P) % _P


def _seeded(_jvm: Any, seed: bytes) -> bytes:
    """Public key of a seed, which the JVM's key interface doesn't give: RFC 8032, section 5.1.5."""
    h = bytearray(hashlib.sha512(seed).digest()[:32])
    h[0] &= 248
    h[31] = (h[31] & 127) | 64
    n, at, out = int.from_bytes(h, "little"), (_root(_BY), _BY), (0, 1)
    while n:
        if n & 1:
            out = _add(out, at)
        at, n = _add(at, at), n >> 1
    return (out[1] | (out[0] & 1) << 255).to_bytes(32, "little")


_STRINGS_AND_SPACE = re.compile(r'("(?:[^"\\]|\\.)*")|[ \t\r\n]+')


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def compact(payload: str) -> str:
    """A JSON text without the white space between its tokens; all else stays byte for byte. Raises ValueError if it is no JSON."""
    json.loads(payload, parse_constant=_no_constant)
    return _STRINGS_AND_SPACE.sub(lambda m: m[1] or "", payload)


def _backwards(path: Path, block: int = 1 << 16) -> Iterator[str]:
    """Lines of a file from the last one on, in bounded memory."""
    with path.open("rb") as f:
        at, rest = f.seek(0, os.SEEK_END), b""
        while at:
            at, n = max(0, at - block), min(at, block)
            f.seek(at)
            rest, *lines = (f.read(n) + rest).split(b"\n")
            yield from (x.decode() for x in reversed(lines) if x.strip())
        if rest.strip():
            yield rest.decode()


_PAYLOAD = re.compile(r'^\{"seq":[0-9]+,"ts_ns":[0-9]+,"payload":(.*),"prev_hash":"[^"]*","hash":"[^"]*"\}\s*$', re.S)


class Trail:
    """An append-only trail in a folder: ``audit.log``, ``checkpoints.log`` and ``batches.log``, one JSON object a line. One writer at
    a time. To go on with a trail only the entries after the last checkpoint and the last whole batch are read, from the end. Of entries
    that await a checkpoint only the roots of complete subtrees are kept. ``on_checkpoint`` is called with each checkpoint once it is on disk."""

    def __init__(self, folder: str, signer: Signer, interval: int = 32, clock=None, on_checkpoint: Callable[[dict], None] | None = None) -> None:
        import time

        self.log, self.marks, self.batches = (Path(folder) / f"{x}.log" for x in ("audit", "checkpoints", "batches"))
        self.log.parent.mkdir(parents=True, exist_ok=True)
        self.signer, self.interval, self.clock = signer, interval, clock or time.time_ns
        last = lambda p: json.loads(next(_backwards(p), "{}")) if p.exists() else {}
        done = last(self.batches)
        self.seq, self.prev, self.peaks, self.on_checkpoint = 0, GENESIS, Peaks(), on_checkpoint
        pending: list[str] = []
        self.marked, self.batch, through = last(self.marks).get("to_seq", 0), done.get("batch"), done.get("to_seq", 0)
        self.loose: list[str] = []  # entries of a batch that was cut short
        for line in _backwards(self.log) if self.log.exists() else ():
            e = json.loads(line)
            if not self.seq:
                self.seq, self.prev = e["seq"], e["hash"]
            if e["seq"] > self.marked:
                pending.append(e["hash"])
            if done and e["seq"] > through:
                self.loose.append(_PAYLOAD.match(line)[1])
            if e["seq"] <= self.marked and (not done or e["seq"] <= through):
                break
        for h in reversed(pending):
            self.peaks.add(h)
        self.loose.reverse()

    def append(self, payloads: list[str], ts_ns: int | None = None) -> None:
        """Add entries, flush once, and sign a checkpoint each ``interval`` entries (none by itself if that is 0)."""
        with self.log.open("a") as f:
            for p in payloads:
                body = compact(p)
                self.seq += 1
                ts = self.clock() if ts_ns is None else ts_ns
                h = hash_entry(self.seq, ts, body.encode(), self.prev)
                f.write(f'{{"seq":{self.seq},"ts_ns":{ts},"payload":{body},"prev_hash":"{self.prev}","hash":"{h}"}}\n')
                self.prev = h
                self.peaks.add(h)
                if self.batch is not None:
                    self.loose.append(body)
                if self.interval > 0 and self.seq - self.marked >= self.interval:
                    f.flush()
                    os.fsync(f.fileno())
                    self.checkpoint()
            f.flush()
            os.fsync(f.fileno())

    def append_batch(self, payloads: list[str], batch_id: int) -> list[dict]:
        """Add the entries of a micro-batch once, however often it comes: what the streaming engine calls before it publishes alerts.

        Batches come in ascending order. Of one that was cut short, only the entries that are missing are added. A trail that is fed
        by batches takes no others in between. Returns the checkpoints signed in the batch, the same ones when it comes again.
        """
        if self.batch is None:
            self._whole_batch(-1)
        if batch_id <= self.batch:
            return self.marks_of(batch_id)
        new = [compact(p) for p in payloads]
        known = 0
        while known < min(len(new), len(self.loose)) and new[known] == self.loose[known]:
            known += 1
        self.append(new[known:])
        self._whole_batch(batch_id)
        return self.marks_of(batch_id)

    def marks_of(self, batch_id: int) -> list[dict]:
        """Checkpoints whose last entry is of a batch."""
        upto, before = None, 0
        for line in _backwards(self.batches):
            b = json.loads(line)
            if b["batch"] == batch_id:
                upto = b["to_seq"]
            elif b["batch"] < batch_id:
                before = b["to_seq"]
                break
        out = []
        for line in _backwards(self.marks) if upto is not None and self.marks.exists() else ():
            c = json.loads(line)
            if c["to_seq"] <= before:
                break
            if c["to_seq"] <= upto:
                out.append(c)
        return out[::-1]

    def _whole_batch(self, batch_id: int) -> None:
        with self.batches.open("a") as f:
            f.write(json.dumps({"batch": batch_id, "to_seq": self.seq}) + "\n")
            f.flush()
            os.fsync(f.fileno())
        self.batch, self.loose = batch_id, []

    def checkpoint(self) -> dict | None:
        """Sign what is pending; None if nothing is."""
        if not self.peaks.count:
            return None
        root = self.peaks.root()
        c = {"from_seq": self.marked + 1, "to_seq": self.seq, "count": self.peaks.count, "merkle_root": root, "signature": self.signer.sign(checkpoint_message(self.marked + 1, self.seq, root)), "public_key": self.signer.public.hex(), "ts_ns": self.clock()}
        with self.marks.open("a") as f:
            f.write(json.dumps(c, separators=(",", ":")) + "\n")
            f.flush()
            os.fsync(f.fileno())
        self.marked, self.peaks = self.seq, Peaks()
        if self.on_checkpoint is not None:
            self.on_checkpoint(c)
        return c

    close = checkpoint


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an audit log with their place; the payload is cut out as text, for parsing would rewrite its numbers.

    Blank lines are skipped; a line that is no entry has null fields and so fails the check.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).where("trim(value) <> ''")
    lines = numbered(lines, ["id"], F.col("block"), "at")
    part = lambda p: F.regexp_extract("value", p, 1)
    head, tail = r'^\{"seq":([0-9]+),', r'"prev_hash":"([^"]*)","hash":"[^"]*"\}\s*$'
    return lines.select(
        "at", part(head).try_cast("bigint").alias("seq"), part(r'^\{"seq":[0-9]+,"ts_ns":([0-9]+),').try_cast("bigint").alias("ts_ns"),
        part(r'^\{"seq":[0-9]+,"ts_ns":[0-9]+,"payload":(.*),"prev_hash":"[^"]*","hash":"[^"]*"\}\s*$').alias("payload"), part(tail).alias("prev_hash"), part(r'"hash":"([^"]*)"\}\s*$').alias("hash"),
    )


MARK = "from_seq bigint, to_seq bigint, count bigint, merkle_root string, signature string, public_key string, ts_ns bigint"


def verify(spark: SparkSession, folder: str, pinned: str | None = None) -> dict:
    """ok, entries, checkpoints, checkpoints_verified, reason, failed_seq of a trail in a folder; missing files are empty.

    Hashes and links are checked by Spark in parallel, roots of checkpoints in groups of their entries; the driver only checks
    signatures, one for each checkpoint.
    """
    log, marks = f"{folder}/audit.log", f"{folder}/checkpoints.log"
    out = {"ok": False, "entries": 0, "checkpoints": 0, "checkpoints_verified": 0, "reason": "", "failed_seq": 0}
    trail = read_log(spark, log) if os.path.exists(log) else None
    if trail is not None:
        fault = chain_faults(trail).orderBy("at").limit(1).collect()
        if fault:
            return out | {"reason": fault[0]["reason"], "failed_seq": fault[0]["seq"] or fault[0]["at"]}
        out["entries"] = trail.count()
    m = spark.read.schema(MARK).json(marks) if os.path.exists(marks) else spark.createDataFrame([], MARK)
    found = m.select("from_seq", "to_seq", "merkle_root", "signature", "public_key")
    if trail is not None:
        roots = _grouped(covered(trail, found, out["entries"]), ["from_seq", "to_seq"], ["seq", "hash"], _range_root, "n bigint, root string")
        found = found.join(roots, ["from_seq", "to_seq"], "left")
    else:
        found = found.withColumns({"n": F.lit(0), "root": F.lit(None).cast("string")})
    rows = found.orderBy("to_seq").toLocalIterator()
    out["checkpoints"] = m.count()
    for r in rows:
        why = ""
        if not r["public_key"] or len(r["public_key"]) != 64:
            why = "malformed checkpoint public key"
        elif pinned and r["public_key"] != pinned:
            why = "checkpoint signed by an unexpected key"
        elif (r["n"] or 0) != r["to_seq"] - r["from_seq"] + 1:
            why = "checkpoint references missing entry"
        elif r["root"] != r["merkle_root"]:
            why = "merkle root mismatch"
        elif not Signer.verify(spark, r["public_key"], checkpoint_message(r["from_seq"], r["to_seq"], r["root"]), r["signature"]):
            why = "invalid checkpoint signature"
        if why:
            return out | {"reason": why, "failed_seq": r["to_seq"]}
        out["checkpoints_verified"] += 1
    return out | {"ok": True}


def covered(trail: DataFrame, marks: DataFrame, entries: int, stretch: int = 1 << 12) -> DataFrame:
    """(from_seq, to_seq, seq, hash) of the entries under each checkpoint: an equality join on stretches of the sequence, with the
    range as further condition. Checkpoints that reach outside the trail are left out."""
    part = lambda c: F.floor(F.col(c) / stretch)
    m = marks.where((F.col("from_seq") >= 1) & (F.col("from_seq") <= F.col("to_seq")) & (F.col("to_seq") <= entries)).select("from_seq", "to_seq").distinct()
    m = m.withColumn("part", F.explode(F.sequence(part("from_seq"), part("to_seq"))))
    t = trail.select("seq", "hash", part("seq").alias("part"))
    return t.join(m, "part").where((F.col("seq") >= F.col("from_seq")) & (F.col("seq") <= F.col("to_seq"))).drop("part")


def _range_root(rows: Iterator[tuple]) -> tuple:
    p = Peaks()
    for _, h in rows:
        p.add(h)
    return p.count, p.root()


def main(argv: list[str] | None = None) -> int:
    """Check a trail from the command line: exit code 0 if it holds, 1 if not, 2 if it can't be read."""
    import argparse

    a = argparse.ArgumentParser(description="Check an audit trail.")
    a.add_argument("folder")
    a.add_argument("--key", help="public key in hexadecimal, or a file with it; else FOLDER/pubkey.hex if there is one")
    a.add_argument("--json", action="store_true")
    x = a.parse_args(argv)
    key = x.key or (f"{x.folder}/pubkey.hex" if os.path.exists(f"{x.folder}/pubkey.hex") else None)
    try:
        pinned = Path(key).read_text().strip() if key and os.path.exists(key) else key
        if not os.path.isdir(x.folder):
            raise OSError(f"{x.folder} is not a folder")
        r = verify(SparkSession.builder.getOrCreate(), x.folder, pinned)
    except OSError as e:
        print(e)
        return 2
    print(json.dumps(r) if x.json else f"{'OK' if r['ok'] else 'FAILED'}: {r['entries']} entries, {r['checkpoints_verified']} of {r['checkpoints']} checkpoints. {r['reason']}")
    return 0 if r["ok"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
