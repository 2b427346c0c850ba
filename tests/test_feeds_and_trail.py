import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anomaly, audit, dashboard, rules, sync
from tidewatch.sources import venues
from tidewatch.sources.tape import restamped, scripted_rows, scripted_tape, tape_of_rows
from tidewatch.types import FEATURES, SCALE, Config


def frames(spark, *raw):
    return spark.createDataFrame([(k, 0, r) for k, r in enumerate(raw)], "seq bigint, ingest_ns bigint, raw string")


def test_binance(spark):
    f = frames(
        spark,
        '{"stream":"btcusdt@depth@100ms","data":{"e":"depthUpdate","E":1700000000000,"s":"BTCUSDT","U":100,"u":105,"b":[["100.50","2.5"],["100.40","0"]],"a":[["100.60","1.0"]]}}',
        '{"stream":"btcusdt@trade","data":{"e":"trade","E":1700000000001,"s":"BTCUSDT","t":555,"p":"100.55","q":"0.3","T":1700000000000,"m":true}}',
        '{"stream":"x@kline","data":{"e":"kline"}}', '{"result":null,"id":1}', "nonsense",
        '{"data":{"e":"depthUpdate","E":1,"s":"X","U":1,"u":1,"b":[["1"]],"a":[]}}',
    )
    r = venues.binance(f).orderBy("seq").collect()
    assert [x.seq for x in r] == [0, 1, 4, 5]
    assert (r[0].kind, r[0].symbol, r[0].first_id, r[0].final_id, r[0].exchange_ts_ms, [(x.p, x.q) for x in r[0].bids], len(r[0].asks)) == ("depth", "BTCUSDT", 100, 105, 1700000000000, [(10050000000, 250000000), (10040000000, 0)], 1)
    assert (r[1].side, r[1].price_raw, r[1].qty_raw, r[1].trade_id, r[1].exchange_ts_ms, r[1].error) == (1, 10055000000, 30000000, 555, 1700000000000, None)
    assert r[2].error == "not JSON" and r[3].error == "bad level"
    s = venues.binance_snapshots(spark.createDataFrame([(0, 0, "X", '{"lastUpdateId":7,"bids":[["1","2"]],"asks":[]}')], "seq bigint, ingest_ns bigint, symbol string, raw string")).first()
    assert s.is_snapshot and s.final_id == 7 and s.bids[0].q == 2 * SCALE


def okx_book(action, seq, prev, bids=(), asks=(), checksum=0):
    row = lambda x: [[p, q, "0", "1"] for p, q in x]
    return json.dumps({"arg": {"channel": "books", "instId": "B"}, "action": action, "data": [{"asks": row(asks), "bids": row(bids), "ts": "17", "checksum": checksum, "seqId": seq, "prevSeqId": prev}]})


def test_okx(spark):
    f = frames(
        spark, "pong", '{"event":"subscribe"}', '{"event":"error","code":"60012","msg":"bad"}', okx_book("snapshot", 100, -1, [("10.0", "1")], [("11", "2")]), okx_book("update", 110, 100, [("10.00", "0")]), okx_book("update", 130, 120, [("9", "1")]), okx_book("update", 140, 130, [("9", "1")]),
        okx_book("snapshot", 150, -1, [("9", "1")]), okx_book("update", 160, 150), okx_book("update", 170, 160, [("8", "1")], checksum=12345),
        json.dumps({"arg": {"channel": "trades", "instId": "B"}, "data": [{"instId": "B", "tradeId": "5", "px": "10", "sz": "2", "side": "sell", "ts": "x"}, {"instId": "B", "tradeId": "6", "px": "?", "sz": "2", "side": "buy", "ts": "1"}]}),
    )
    assert venues.okx_errors(f).first().code == "60012"
    out = venues.okx(f).orderBy("seq").collect()
    t = [x for x in out if x.kind == "trade"]
    assert len(t) == 1 and (t[0].side, t[0].price_raw, t[0].exchange_ts_ms, t[0].trade_id) == (1, 10 * SCALE, 0, 5)
    got = [(r.seq // 1000, r.outcome, r.published) for r in sync.continuity(venues.okx_books(f)).orderBy("seq").collect()]
    assert got == [(3, "ok", True), (4, "ok", True), (5, "gap", False), (6, "waiting", False), (7, "ok", True), (8, "ok", False), (9, "checksum", False)]


def test_frames_with_too_many_items_are_an_error(spark):
    item = {"instId": "B", "tradeId": "1", "px": "1", "sz": "1", "side": "buy", "ts": "1"}
    push = lambda n: json.dumps({"arg": {"channel": "trades", "instId": "B"}, "data": [item] * n})
    assert venues.okx(frames(spark, push(1000), push(1))).agg(F.countDistinct("seq")).first()[0] == 1001
    with pytest.raises(Exception, match="more than 1000 items"):
        venues.okx(frames(spark, push(1001))).collect()


def test_checksum(spark):
    rows = [("S", 0, 1, "3366.1", "7"), ("S", 1, 1, "3366.8", "9"), ("S", 1, 2, "3368", "8"), ("S", 1, 3, "3372", "8")]
    r = sync.checksum_payload(spark.createDataFrame(rows, "symbol string, side int, rank int, price string, size string")).first()
    assert r.payload == "3366.1:7:3366.8:9:3368:8:3372:8"
    assert r.checksum == sync._crc(r.payload)
    ladder = sync.Strings()
    ladder.apply(0, [["3366.1", "7"]])
    ladder.apply(1, [[p, q] for _, s, _, p, q in rows if s == 1])
    assert ladder.payload() == r.payload


def let_through(s, diffs):
    """Indices of the diffs that pass after snapshot ``s``, and of the one that leaves a hole, from the published rules: those that end at
    or before what is known are old; the first other one may reach back before s + 1, later ones follow on exactly."""
    known, passed = s, []
    for k, (first, final) in enumerate(diffs):
        if final <= known:
            continue
        if (first > s + 1) if not passed else (first != known + 1):
            return passed, k
        known = final
        passed.append(k)
    return passed, None


def model(messages, limit):
    """(message, items that it lets through) by cutting the messages at snapshots, and how many holes there were."""
    cuts = [k for k, m in enumerate(messages) if m[0]]
    part = lambda a, b: [k for k in range(a, b) if not messages[k][0]]
    held, out, holes = part(0, cuts[0] if cuts else len(messages))[-limit:], [], 0
    for at, to in zip(cuts, [*cuts[1:], len(messages)], strict=False):
        later = part(at + 1, to)
        diffs = held + later
        passed, hole = let_through(messages[at][2], [messages[k][1:] for k in diffs])
        holes += hole is not None
        if hole is not None and hole < len(held):
            held = later[-limit:]
            continue
        out.append((at, [at, *(diffs[k] for k in passed if k < len(held))]))
        out += [(diffs[k], [diffs[k]]) for k in passed if k >= len(held)]
        held = diffs[hole:][-limit:] if hole is not None else []
    return out, holes


def feed(r, n):
    """Diffs that mostly follow on, with overlaps, repeats and holes, and snapshots near the present, as (is_snapshot, first, final)."""
    now, out = 0, []
    for _ in range(n):
        kind = r.random()
        if kind < 0.12:
            out.append((True, None, max(0, now - r.randint(0, 6))))
            continue
        first = now + 1 + (r.randint(1, 4) if kind > 0.96 else 0) - (r.randint(1, 3) if 0.9 < kind <= 0.96 else 0)
        final = first + r.randint(0, 3)
        out.append((False, first, final))
        now = max(now, final)
    return out


def test_sync_against_the_rules():
    r = random.Random(21)
    for trial in range(400):
        messages, limit = feed(r, r.randint(1, 60)), r.choice((1, 2, 5, 100))
        state, got = sync.Feed(), []
        for k, (snapshot, first, final) in enumerate(messages):
            state, what, out = sync.advance(state, snapshot, first, final, k, limit)
            assert bool(out) == (what in ("synced", "apply"))
            got += [(k, out)] if out else []
        assert (got, state.resyncs) == model(messages, limit), (trial, messages)


def test_what_reaches_the_books(spark):
    """Frames of two books in the order in which they pass, from the plan, are those of the model; released rows sort by it."""
    r = random.Random(22)
    rows, want = [], {}
    for symbol in ("A", "B"):
        messages = feed(r, 80)
        own = [{"seq": len(rows) + k, "ts_ns": k * 1000, "ingest_ns": k, "symbol": symbol, "exchange": "x", "kind": "depth", "is_snapshot": s, "side": None, "price_raw": None, "qty_raw": None, "first_id": a, "final_id": b, "bids": [{"p": 1, "q": k + 1}], "asks": []} for k, (s, a, b) in enumerate(messages)]
        want[symbol] = [(len(rows) + at, [len(rows) + k for k in items]) for at, items in model(messages, sync.BUFFER)[0]]
        rows += own
    tape = tape_of_rows(spark, rows)
    out = sync.released(tape).orderBy("symbol", "seq").collect()
    for symbol, passed in want.items():
        mine = [x for x in out if x.symbol == symbol]
        assert [x.origin_seq for x in mine] == [k for _, items in passed for k in items]
        assert [x.ts_ns for x in mine] == [max(next(y["ts_ns"] for y in rows if y["seq"] == k), next(y["ts_ns"] for y in rows if y["seq"] == at)) for at, items in passed for k in items]
    known, expected = {}, []
    for x in rows:
        if not x["is_snapshot"]:
            if x["symbol"] in known and x["first_id"] != known[x["symbol"]] + 1:
                expected.append((x["seq"], known[x["symbol"]] + 1))
            known[x["symbol"]] = x["final_id"]
    assert [(x.seq, x.expected_id) for x in sync.gaps(tape).orderBy("seq").collect()] == expected


def test_frames_to_alerts(spark):
    """Venue frames, the sequence check and the rules as one path: a diff that waited for its snapshot counts like any other."""
    put = lambda u, bids, asks=(): json.dumps({"stream": "s@depth", "data": {"e": "depthUpdate", "E": 1, "s": "S", "U": u, "u": u, "b": [[f"{p:.2f}", str(q)] for p, q in bids], "a": [[f"{p:.2f}", str(q)] for p, q in asks]}})
    raw = [put(7, [(99.5, 2)], [(101, 1)]), *(put(8 + k, [(99 - k / 10, 1 + k % 2)]) for k in range(18)), put(26, [(99.9, 40)]), put(27, [(99.9, 1)])]
    diffs = venues.binance(spark.createDataFrame([(k if k < 3 else k + 1, k * 10**8, x) for k, x in enumerate(raw)], "seq bigint, ingest_ns bigint, raw string"))
    snap = venues.binance_snapshots(spark.createDataFrame([(3, 25 * 10**7, "S", '{"lastUpdateId":7,"bids":[["99.00","1"]],"asks":[["100.50","1"]]}')], "seq bigint, ingest_ns bigint, symbol string, raw string"))
    tape = venues.union(diffs, snap).withColumn("ts_ns", F.col("ingest_ns") + F.lit(10**12))
    ready = sync.released(tape)
    assert ready.count() == 21  # all but the diff that the snapshot already holds
    from tidewatch.operators import book

    assert book.deltas(ready).where("seq = 3 * 8192 + 2").count() == 1
    assert [(x.detector, x.seq) for x in rules.alerts(ready, Config(spoof_max_bps=200.0)).collect()] == [("spoofing", 21 * 8192)]


def bodies(n, seed=1):
    r = random.Random(seed)
    return [f'{{ "id" : "a{k} x", "price": {r.randrange(100)}.50,\n "big": 12345678901234567890.{k}, "twice": 1, "twice": [ ] }}' for k in range(n)]


def trail(spark, path, n=23, interval=5):
    t = audit.Trail(str(path), audit.Signer.load(spark, str(path / "key")), interval, clock=lambda: 5)
    t.append(bodies(n))
    t.close()
    return t


def test_trail(spark, tmp_path):
    t = trail(spark, tmp_path)
    r = audit.verify(spark, str(tmp_path), t.signer.public.hex())
    assert (r["ok"], r["entries"], r["checkpoints"], r["checkpoints_verified"]) == (True, 23, 5, 5)
    again = audit.Trail(str(tmp_path), t.signer, 5, clock=lambda: 6)
    assert (again.seq, again.prev, again.peaks.count) == (t.seq, t.prev, 0)
    again.append(bodies(3, 2))
    more = audit.Trail(str(tmp_path), t.signer, 5, clock=lambda: 6)
    assert (more.seq, more.marked, more.peaks.stack) == (26, 23, again.peaks.stack)
    more.close()
    assert audit.verify(spark, str(tmp_path))["entries"] == 26
    assert not audit.verify(spark, str(tmp_path), "00" * 32)["ok"]
    assert audit.verify(spark, str(tmp_path / "none"))["ok"]


def test_payloads_keep_their_bytes():
    for k, p in enumerate(bodies(4)):
        got = audit.compact(p)
        assert f'"id":"a{k} x"' in got and '.50,"big":12345678901234567890.' in got and got.count('"twice"') == 2 and "\n" not in got and json.loads(got) == json.loads(p)
    for bad in ("", "{", "NaN", '{"a":Infinity}', "{'a':1}"):
        with pytest.raises(ValueError):
            audit.compact(bad)


def test_batches_come_once(spark, tmp_path):
    signer = audit.Signer(spark, bytes(32))
    open_ = lambda: audit.Trail(str(tmp_path), signer, 4, clock=lambda: 7)
    t = open_()
    t.append_batch(bodies(6), 0)
    t.append_batch(bodies(6), 0)
    t.append_batch([], 1)
    assert t.seq == 6
    t.append(bodies(3, 5))  # a batch that is cut short after three of its entries
    t = open_()
    assert len(t.loose) == 3
    t.append_batch(bodies(8, 5), 2)
    t = open_()
    t.append_batch(bodies(8, 5), 2)
    t.append_batch(bodies(2, 9), 3)
    t.close()
    assert t.seq == 16 and audit.verify(spark, str(tmp_path))["ok"]
    assert {json.loads(x)["ts_ns"] for x in (tmp_path / "audit.log").read_text().splitlines()} == {7}


@pytest.mark.parametrize("seed", range(5))
def test_tampering(spark, tmp_path, seed):
    """A change at a random entry is found at that entry."""
    r = random.Random(seed)
    trail(spark, tmp_path)
    log, marks = tmp_path / "audit.log", tmp_path / "checkpoints.log"
    lines = log.read_text().splitlines()
    at = r.randrange(1, len(lines) - 1)
    if seed == 0:
        lines[at] = lines[at].replace(".50,", ".51,")
        want = ("hash mismatch", at + 1)
    elif seed == 1:
        lines[at - 1], lines[at] = lines[at], lines[at - 1]
        want = ("sequence break", at + 1)
    elif seed == 2:
        del lines[at]
        want = ("sequence break", at + 2)
    elif seed == 3:
        lines = lines[:-1]
        want = ("missing entry", 23)
    else:
        c = [json.loads(x) for x in marks.read_text().splitlines()]
        k = r.randrange(len(c))
        c[k]["signature"] = c[k]["signature"][:-2] + ("00" if c[k]["signature"][-2:] != "00" else "01")
        marks.write_text("".join(json.dumps(x) + "\n" for x in c))
        want = ("invalid checkpoint signature", c[k]["to_seq"])
    log.write_text("\n".join(lines) + "\n")
    got = audit.verify(spark, str(tmp_path))
    assert not got["ok"] and want[0] in got["reason"] and got["failed_seq"] == want[1]
    assert audit.main([str(tmp_path), "--json"]) == 1


def test_check_from_the_command_line(spark, tmp_path, capsys):
    t = trail(spark, tmp_path / "a") if (tmp_path / "a").mkdir() is None else None
    (tmp_path / "a" / "pubkey.hex").write_text(t.signer.public.hex())
    assert audit.main([str(tmp_path / "a"), "--json"]) == 0 and json.loads(capsys.readouterr().out)["entries"] == 23
    assert audit.main([str(tmp_path / "a"), "--key", "11" * 32]) == 1 and audit.main([str(tmp_path / "none")]) == 2


def test_checkpoints_are_joined_by_equality(spark, tmp_path):
    trail(spark, tmp_path)
    log = audit.read_log(spark, str(tmp_path / "audit.log"))
    marks = spark.read.schema(audit.MARK).json(str(tmp_path / "checkpoints.log"))
    odd = spark.createDataFrame([(1, 10**15), (0, 3), (9, 2)], "from_seq bigint, to_seq bigint")
    inside = audit.covered(log, marks.select("from_seq", "to_seq").union(odd), 23, stretch=4)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert sorted((x.from_seq, x.seq) for x in inside.collect()) == [((k - 1) // 5 * 5 + 1, k) for k in range(1, 24)]


def test_keys_and_roots(spark):
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    s = audit.Signer(spark, seed)
    assert s.public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert s.sign(b"").startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert audit.Signer.verify(spark, s.public.hex(), b"", s.sign(b"")) and not audit.Signer.verify(spark, s.public.hex(), b"x", s.sign(b""))
    h = ["%064x" % k for k in range(4)]
    assert audit.merkle_root(h[:3]) != audit.merkle_root([*h[:2], h[3]]) and audit.merkle_root(h[:1]) != audit.merkle_root([h[0], h[0]]) and audit.merkle_root([]) == audit.EMPTY_ROOT


def test_peaks_are_the_root(spark, monkeypatch):
    """Entries one by one, subtrees of blocks joined, and intervals of any length give the root over all."""
    h = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(70)]
    p = audit.Peaks()
    for n in range(70):
        assert p.root() == audit.merkle_root(h[:n]) and len(p.stack) == bin(n).count("1")
        p.add(h[n])
    with pytest.raises(ValueError, match="complete"):
        p.join(3, b"")
    monkeypatch.setattr(audit, "BLOCK", 8)
    log = spark.createDataFrame([(k + 1, x) for k, x in enumerate(h)], "seq bigint, hash string").repartition(4)
    for interval in (1, 7, 16, 64, 1000):
        want = [(at + 1, min(70, at + interval), min(70, at + interval) - at, audit.merkle_root(h[at : at + interval])) for at in range(0, 70, interval)]
        assert sorted(map(tuple, audit.merkle_roots(log, interval).collect())) == want


def test_dashboard(spark):
    a = rules.alerts(scripted_tape(spark), Config()).persist()
    assert {(r.detector, r.severity_label): r.n for r in dashboard.totals(a).collect()}[(None, None)] == 6
    assert [r.n for r in dashboard.recent(a, "2").collect()] == [6, 5] and dashboard.recent(a, "x").count() == 6
    assert [dashboard.page_size(x) for x in ("", "0", "7", None, "-3")] == [100, 100, 7, 100, 100]
    assert {r.le: r.n for r in dashboard.latency_histogram(a).collect()}["+Inf"] == 6
    s = dashboard.stats(a, 60.0).first()
    assert (s.total, s.urgent, s.alerts_per_min) == (6, 4, 6.0)
    a.unpersist()


def test_playback(spark):
    r = restamped(scripted_tape(spark), 2.0, 0).agg(F.min("ts_ns"), F.max("ts_ns")).first()
    rows = scripted_rows()
    assert r[0] == 0 and r[1] == (rows[-1]["ts_ns"] - rows[0]["ts_ns"]) // 2


def test_anomalies(spark):
    rng = np.random.default_rng(1)
    rows = [("S", k, k * 10**9, *map(float, np.array([1, 0, 0, 5, 0, 0.5, 20, 20]) + rng.normal(0, 0.1, 8))) for k in range(200)]
    rows += [("S", 200, 200 * 10**9, 12.0, 0.95, 8.0, 0.1, 0.0, 0.99, 300.0, 2.0), ("S", 201, 201 * 10**9, 1.0, 0.0, 0.0, 5.0, 0.0, 0.5, 20.0, 20.0)]
    v = spark.createDataFrame(rows, "symbol string, seq bigint, ts_ns bigint, " + ", ".join(f"{f} double" for f in FEATURES))
    d = {r.seq: r for r in anomaly.decisions(v).collect()}
    assert len(d) == 52 and d[200].decision < 0 < d[201].decision and d[150].version == 1
    out = anomaly.alerts(v).collect()
    assert any(r.seq == 200 and 0 <= r.score <= 1 for r in out)
    versions = [r.version for r in anomaly.schedule(v, 10, 5).orderBy("n").collect()]
    assert versions[:17] == [0] * 10 + [1] * 5 + [2] * 2


@pytest.mark.parametrize("files", [1, 3])
def test_stream_is_the_batch(spark, tmp_path, files):
    from tidewatch.sources.tape import stream_of
    from tidewatch.streaming import engine

    rows = scripted_rows()
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        p = tmp_path / "in" / f"{k}.json"
        p.parent.mkdir(exist_ok=True)
        p.write_text("\n".join([*map(json.dumps, part), "not json"]) + "\n")
        import os

        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    signed = []
    kept, trail_ = [], audit.Trail(str(tmp_path / "trail"), audit.Signer(spark, bytes(32)), 2, on_checkpoint=lambda c: signed.append(c))

    def append(payloads, batch):
        kept.append((batch, len(payloads)))
        first, again = (trail_.append_batch(payloads, batch) for _ in range(2))  # a batch may come again
        assert first == again
        return again

    q = engine.start(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "cp"), str(tmp_path / "alerts"), str(tmp_path / "features"), append=append, checkpoints_path=str(tmp_path / "marks"))
    q.awaitTermination()
    got = [(r.seq, r.detector, round(r.score, 9), json.loads(r.body)) for r in spark.read.parquet(str(tmp_path / "alerts")).orderBy("seq", F.desc("detector")).collect()]
    want = [(r.seq, r.detector, round(r.score, 9), json.loads(r.evidence)) for r in rules.alerts(tape_of_rows(spark, rows), Config()).orderBy("seq", F.desc("detector")).collect()]
    assert got == want and sum(n for _, n in kept) == len(want)
    trail_.close()
    kept_in_trail = audit.verify(spark, str(tmp_path / "trail"))
    assert kept_in_trail["ok"] and kept_in_trail["entries"] == len(want)
    marks = [json.loads(x) for x in (tmp_path / "trail" / "checkpoints.log").read_text().splitlines()]
    table = [r.asDict() for r in spark.read.parquet(str(tmp_path / "marks")).drop("batch").orderBy("to_seq").collect()]
    assert table == marks and [m["to_seq"] for m in marks] == [2, 4, 6] == [m["to_seq"] for m in signed]
    assert spark.read.parquet(str(tmp_path / "features")).count() == 2


def test_forest_by_walking_its_trees():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), np.repeat([[5.0, 5.0, 5.0]], 20, axis=0)])
    f = anomaly.Forest(x, trees=7, sample=64)

    def depth(row, node):
        while f.feature[node] >= 0:
            node = f.left[node] if row[f.feature[node]] <= f.cut[node] else f.right[node]
        return f.depth[node]

    for row in x[::37]:
        mean = np.mean([depth(row, t) for t in range(7)])
        assert abs(f.score(row[None, :])[0] + 2.0 ** (-mean / float(anomaly._depth(64)))) < 1e-12
    same = np.ones((50, 2))
    assert np.allclose(anomaly.Forest(same, trees=3).score(same), -0.5, atol=0.2)


def test_roots_of_many_small_intervals_take_one_pass(spark):
    """20,000 entries in intervals of 2: a call for each interval would take about a hundred seconds here."""
    import time

    h = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(20_000)]
    log = spark.createDataFrame([(k + 1, x) for k, x in enumerate(h)], "seq long, hash string").coalesce(1)
    began = time.monotonic()
    got = sorted(map(tuple, audit.merkle_roots(log, 2).collect()))
    assert time.monotonic() - began < 30
    assert got == [(k + 1, k + 2, 2, audit.merkle_root(h[k : k + 2])) for k in range(0, 20_000, 2)]


def test_frames_of_a_feed_are_read_once(spark, data):
    """Depth messages, trades, the sequence check and release times all come from frames; none of them reads the JSON again."""
    from tidewatch.plans import queries
    from tidewatch.sources.tape import read_tape

    plan = queries.feed_sync(read_tape(spark, f"{data}/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan.lower()
