import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import book, features, rules, windows
from tidewatch.sources.tape import scripted_rows, scripted_tape, tape_of_rows
from tidewatch.streaming.engine import SymbolState
from tidewatch.types import BUY, MS, SCALE, SEC, SELL, Config

T0 = 10**12


def depth(ts, bids=(), asks=(), snapshot=False, symbol="S"):
    lv = lambda x: [{"p": round(p * SCALE), "q": round(q * SCALE)} for p, q in x]
    return {"ts_ns": T0 + ts, "kind": "depth", "symbol": symbol, "is_snapshot": snapshot, "bids": lv(bids), "asks": lv(asks), "side": None, "price_raw": None, "qty_raw": None}


def trade(ts, price, qty, side, symbol="S"):
    return {"ts_ns": T0 + ts, "kind": "trade", "symbol": symbol, "is_snapshot": False, "bids": [], "asks": [], "side": side, "price_raw": round(price * SCALE), "qty_raw": round(qty * SCALE)}


def done(rows):
    return [r | {"seq": k, "ingest_ns": r["ts_ns"], "exchange": "x", "first_id": k, "final_id": k} for k, r in enumerate(rows)]


def by_engine(rows, cfg):
    states, out = {}, []
    for r in rows:
        s = states.setdefault(r["symbol"], SymbolState(cfg))
        out += [(r["symbol"], *x) for x in s.event(SimpleNamespace(**r))]
    alerts = [(x[0], x[1], x[4], round(x[7], 9)) for x in out if x[3] == "alert"]
    vectors = [(x[0], x[1], tuple(round(v, 6) for v in json.loads(x[9]).values())) for x in out if x[3] == "features"]
    return alerts, vectors


def by_plan(spark, rows, cfg):
    tape = tape_of_rows(spark, rows).persist()
    alerts = [(r.symbol, r.seq, r.detector, round(r.score, 9)) for r in rules.alerts(tape, cfg).orderBy("n").collect()]
    vectors = [(r.symbol, r.seq, tuple(round(x, 6) for x in r[3:])) for r in features.vectors(tape, cfg).orderBy("seq").collect()]
    tape.unpersist()
    return alerts, vectors


def test_scripted_tape(spark):
    got = [(r.id, (r.ts_ns - T0) / MS, r.severity_label, round(r.score, 4), r.detect_latency_us) for r in rules.alerts(scripted_tape(spark), Config()).orderBy("n").collect()]
    assert got == [
        ("BTCUSDT-spoofing-1", 1900.0, "high", 1.0, 0), ("BTCUSDT-spoofing-2", 3200.0, "high", 1.0, 0), ("BTCUSDT-layering-3", 3230.0, "critical", 0.5, 0),
        ("BTCUSDT-momentum_ignition-4", 4590.0, "high", 0.5111, 0), ("BTCUSDT-quote_stuffing-5", 9290.0, "medium", 0.5, 0), ("BTCUSDT-wash_trade-6", 17790.0, "low", 0.5, 0),
    ]
    first = json.loads(rules.alerts(scripted_tape(spark), Config()).where("n = 1").first().evidence)
    assert first == {"side": "buy", "price": "30000", "flagged_qty": "30", "typical_qty": 1.0, "size_multiple": 30.0, "lifetime_ms": 1000.0, "traded_qty": "0"}
    v = features.vectors(scripted_tape(spark), Config()).orderBy("seq").collect()
    assert [((r.ts_ns - T0) / MS, r.trade_intensity, r.signed_vol, r.cancel_ratio, r.bid_depth, r.ask_depth) for r in v] == [(95.0, 0.0, 0.0, 0.0, 24.0, 5.0), (17290.0, 0.5, 0.5, 0.0, 275.0, 5.0)]


def warm():
    rows = [depth(0, [(100.00, 1), (99.99, 1), (99.98, 1)], [(100.02, 1), (100.03, 1), (100.04, 1)], True)]
    return rows + [depth((k + 1) * MS, [(99.50 - k * 0.01, 1)]) for k in range(20)]


CASES = {
    "spoof": (warm() + [depth(SEC, [(100, 30)]), depth(2 * SEC, [(100, 1)])], ["spoofing"]),
    "executed": (warm() + [depth(SEC, [(100, 30)]), trade(1500 * MS, 100, 10, SELL), depth(2 * SEC, [(100, 1)])], []),
    "late": (warm() + [depth(SEC, [(100, 30)]), depth(6 * SEC, [(100, 1)])], []),
    "cooldown": (warm() + [depth(SEC + k * 300 * MS, [(100, 30 if k % 2 == 0 else 1)]) for k in range(4)], ["spoofing"]),
    "snapshot between": (warm() + [depth(SEC, [(100, 30)]), depth(SEC + 1, [(100, 30), (99, 1)], [(100.02, 1)], True), depth(2 * SEC, [(100, 1)])], ["spoofing"]),
    "ignition": ([trade(k * 100 * MS, p, 2, BUY) for k, p in enumerate((100, 100.05, 100.10, 100.16))] + [trade(600 * MS, 100.05, 2, SELL)], ["momentum_ignition"]),
    "ignition down": ([trade(k * 100 * MS, p, 2, SELL) for k, p in enumerate((100, 99.95, 99.90, 99.84))] + [trade(600 * MS, 99.95, 2, BUY)], ["momentum_ignition"]),
    "steady": ([trade(k * 150 * MS, p, 2, BUY) for k, p in enumerate((100, 100.05, 100.10, 100.16, 100.20, 100.25))], []),
    "stuffing": ([depth(0, [(100, 1)], [(101, 1)], True)] + [depth((1 + k) * 50 * MS, [(90 + (50 * k + i) * 0.01, 1) for i in range(50)]) for k in range(5)], ["quote_stuffing"]),
    "traded": ([depth(0, [(100, 1)], [(101, 1)], True)] + [trade(k, 100, 1, BUY) for k in range(4)] + [depth((1 + k) * 50 * MS, [(90 + (50 * k + i) * 0.01, 1) for i in range(50)]) for k in range(5)], []),
    "wash": ([trade(k * 100 * MS, 100 if k % 2 == 0 else 100.001, 0.5, k % 2) for k in range(8)], ["wash_trade"]),
    "one side": ([trade(k * 100 * MS, 100, 0.5, BUY) for k in range(8)], []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    rows, want = CASES[name]
    alerts, _ = by_plan(spark, done(rows), Config())
    assert [a[2] for a in alerts] == want
    assert by_engine(done(rows), Config())[0] == alerts


def random_rows(seed, n=260):
    r = random.Random(seed)
    rows, ts = [], 0
    for _ in range(n):
        ts += r.choice((0, 0, 1, 40 * MS, 200 * MS, 900 * MS))
        symbol = r.choice("AB")
        x = r.random()
        if x < 0.03:
            rows.append(depth(ts, [(100 - k * 0.01, r.randint(0, 3)) for k in range(3)], [(100.02 + k * 0.01, r.randint(0, 3)) for k in range(3)], True, symbol))
        elif x < 0.65:
            level = lambda: (round(100 + r.randint(-3, 3) * 0.01, 2), r.choice((0, 1, 1, 2, 30)))
            rows.append(depth(ts, [level() for _ in range(r.randint(0, 3))], [level() for _ in range(r.randint(0, 2))], False, symbol))
        else:
            rows.append(trade(ts, round(100 + r.randint(-3, 3) * 0.05, 2), r.randint(1, 4), r.randint(0, 1), symbol))
    return done(rows)


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_the_engine(spark, seed):
    cfg = Config(spoof_multiple=3.0, spoof_min_samples=3, layering_levels=2, stuff_churn=4, stuff_max_trades=2, ignite_bps=5.0, ignite_volume=2.0, wash_min_trades=3, wash_band_bps=30.0, feature_every=5)
    rows = random_rows(seed)
    alerts, vectors = by_plan(spark, rows, cfg)
    want_alerts, want_vectors = by_engine(rows, cfg)
    assert len({a[2] for a in want_alerts}) >= 3 and want_vectors
    assert alerts == want_alerts
    assert vectors == want_vectors


@pytest.mark.parametrize(("seed", "stretch"), [(3, 2), (4, 5), (5, 9)])
def test_stretches_know_nothing_of_one_another(spark, seed, stretch):
    """Books and features of short stretches, each from a carried book, are those of one pass in memory."""
    cfg = Config(feature_every=3, feature_window=SEC)
    rows = random_rows(seed, 400)
    tape = tape_of_rows(spark, rows).repartition(3).persist()
    got = {(r.symbol, r.seq): tuple(r)[3:] for r in book.state(tape, 2, stretch * SEC).collect()}
    ladders, want = {}, {}
    for x in rows:
        if x["kind"] == "depth":
            b = ladders.setdefault(x["symbol"], book.Ladder())
            b.apply(x["is_snapshot"], [(s, y["p"], y["q"]) for s, c in ((BUY, "bids"), (SELL, "asks")) for y in x[c]])
            if b.synced:
                bid, ask = b.top(BUY, 2), b.top(SELL, 2)
                best = lambda t: t[0] if t else (None, None)
                want[x["symbol"], x["seq"]] = (*best(bid), *best(ask), sum(q for _, q in bid), sum(q for _, q in ask), b.depth(BUY), b.depth(SELL))
    assert got == want and len(got) > 100
    vectors = [(r.symbol, r.seq, tuple(round(x, 6) for x in r[3:])) for r in features.vectors(tape, cfg, stretch * SEC).orderBy("seq").collect()]
    assert vectors == by_engine(rows, cfg)[1] and len(vectors) > 50
    tape.unpersist()


def quotes_in_one_pass(rows, cfg):
    """As in memory: each symbol's book, average and changes, message by message."""
    out, states = [], {}
    for x in rows:
        if x["kind"] != "depth":
            continue
        ladder, typical, times, last = states.setdefault(x["symbol"], (book.Ladder(), rules.Typical(), [], [0]))
        changed = ladder.apply(x["is_snapshot"], [(s, y["p"], y["q"]) for s, c in ((BUY, "bids"), (SELL, "asks")) for y in x[c]])
        times += [x["ts_ns"]] * len(changed)
        if changed:
            last[0] = sum(t >= x["ts_ns"] - cfg.stuff_window for t in times)
        for pos, side, price, old, new in changed:
            flagged = new > old and typical.add(cfg, new / SCALE, price / SCALE, ladder.mid())
            out.append((x["symbol"], x["seq"], x["ts_ns"], pos, side, price, new, new > old, flagged, typical.mean, typical.samples, None, x["ingest_ns"]))
        if not x["is_snapshot"] and last[0] >= cfg.stuff_churn:
            out.append((x["symbol"], x["seq"], x["ts_ns"], *[None] * 8, last[0], x["ingest_ns"]))
    return out


@pytest.mark.parametrize(("seed", "stretch", "piece"), [(6, 2, 1), (7, 5, 3), (8, 600, 4)])
def test_quotes_by_stretch(spark, seed, stretch, piece):
    """Short stretches in small pieces, stretches that begin without changes, and a symbol that is quiet for some: as in one pass, to the bit."""
    cfg = Config(spoof_multiple=2.0, spoof_min_samples=3, stuff_churn=3)
    rows = random_rows(seed, 300)
    late = rows[-1]["ts_ns"] - T0 + 20 * SEC
    rows = done(rows + [depth(late + k * SEC, [(99, 1)] if k % 4 else [(99, 1), (98, k), (97, k), (96, k)], symbol="A") for k in range(13)] + [depth(late + 14 * SEC, symbol="B")])
    tape = tape_of_rows(spark, rows).repartition(3)
    got = rules.quotes(tape, cfg, "ingest_ns", stretch=stretch * SEC, piece=piece)
    order = lambda x: (x[1], x[3] is None, x[3] or 0)
    want = quotes_in_one_pass(rows, cfg)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order) and any(x[8] for x in want) and any(x[11] for x in want)


def test_counts_make_no_evidence(spark):
    tape = scripted_tape(spark)
    plain = rules.alerts(tape, Config(), ordered=False)
    counted = plain.groupBy("detector", "severity_label").agg(F.count(F.lit(1)).alias("n"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "StructsToJson" not in plan and "to_json" not in plan
    assert sorted(map(tuple, counted.collect())) == [("layering", "critical", 1), ("momentum_ignition", "high", 1), ("quote_stuffing", "medium", 1), ("spoofing", "high", 2), ("wash_trade", "low", 1)]
    numbered = rules.alerts(tape, Config())
    assert sorted(map(tuple, plain.select("seq", "detector", "score", "evidence").collect())) == sorted(map(tuple, numbered.select("seq", "detector", "score", "evidence").collect()))


def test_alerts_wait_until_they_are_asked_for(spark, tmp_path):
    """Building the plan runs no job."""
    tape = tape_of_rows(spark, CASES["spoof"][0] and done(CASES["spoof"][0]))
    group = "plan-only"
    spark.sparkContext.setJobGroup(group, "")
    out = rules.alerts(tape, Config())
    assert out.columns[0] == "id" and not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 1


def test_clock_below_the_cooldown(spark):
    rows = done([r | {"ts_ns": r["ts_ns"] - T0} for r in CASES["wash"][0]])
    assert by_plan(spark, rows, Config())[0] == []


def test_book(spark):
    rows = done([depth(0, [(99, 5)]), depth(1, [(100, 1), (99.5, 2), (99, 3)], [(100.5, 1), (101, 2), (101.5, 3)], True), depth(2, [(100, 20)]), depth(3, [(100, 0), (98, 0), (97, 4), (97, 4)], [(100.5, 0)])])
    tape = tape_of_rows(spark, rows)
    d = [(r.seq, r.side, r.price_raw // SCALE, r.old_raw // SCALE, r.new_raw // SCALE, r.added) for r in book.deltas(tape).orderBy("seq", "pos").collect()]
    assert d == [(2, 0, 100, 1, 20, True), (3, 0, 100, 20, 0, False), (3, 0, 97, 0, 4, True), (3, 1, 100, 1, 0, False)]
    s = book.with_prices(book.state(tape, 2)).orderBy("seq").collect()
    assert [r.seq for r in s] == [1, 2, 3]
    assert (s[0].bid_raw, s[0].ask_raw, s[0].bid_top_raw, s[0].bid_depth) == (100 * SCALE, 100.5 * SCALE, 3 * SCALE, 3)
    assert s[1].micro > s[1].mid and s[2].bid_raw == 99.5 * SCALE and s[2].ask_depth == 2
    assert [(r.side, r.rank, r.price_raw / SCALE) for r in book.last_levels(tape).orderBy("side", "rank").collect()] == [(0, 1, 99.5), (0, 2, 99.0), (0, 3, 97.0), (1, 1, 101.0), (1, 2, 101.5)]


def test_rows_of_one_time(spark, monkeypatch):
    rows = spark.createDataFrame([("S", 10**12 + 7 * (k >= 4), k) for k in range(8)], "symbol string, ts_ns bigint, seq bigint")
    counted = lambda: windows.sliding(rows, 5, ["seq"], {"n": lambda w: F.count(F.lit(1)).over(w)})
    monkeypatch.setattr(windows, "_PEERS", 8)
    assert [r.n for r in counted().orderBy("seq").collect()] == [1, 2, 3, 4, 1, 2, 3, 4]
    monkeypatch.setattr(windows, "_PEERS", 4)
    with pytest.raises(Exception, match="rows of a symbol have one time"):
        counted().collect()


def test_empty_tape(spark):
    tape = tape_of_rows(spark, [])
    assert rules.alerts(tape, Config()).count() == 0 and features.vectors(tape, Config()).count() == 0


def test_scripted_rows_are_47():
    assert len(scripted_rows()) == 47
