"""Keyed state of the stream: the same outcome as in memory, however a tape is cut into batches, and only touched keys written."""

import json
import random
import sys
import time
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle
from test_rules import random_rows

from tidewatch.operators.book import Ladder
from tidewatch.sources.tape import scripted_tape
from tidewatch.streaming.engine import Keeper, StreamRule, SymbolState
from tidewatch.streaming.ladder import FULL, BucketLadder
from tidewatch.streaming.metrics import Metrics
from tidewatch.types import BUY, LATENCY_BOUNDS, MS, SCALE, SEC, SELL, Config

CFG = Config(spoof_multiple=3.0, spoof_min_samples=3, layering_levels=2, stuff_churn=4, stuff_max_trades=2, ignite_bps=5.0, ignite_volume=2.0, wash_min_trades=3, wash_band_bps=30.0, feature_every=5)


class Counted:
    """A store in memory that counts, and holds what a row can hold."""

    def __init__(self):
        self.rows, self.reads, self.writes = {}, 0, 0

    def get(self, key):
        self.reads += 1
        return json.loads(self.rows[key]) if key in self.rows else None

    def put(self, key, value):
        self.writes += 1
        self.rows[key] = json.dumps(value)

    def remove(self, key):
        self.writes += 1
        del self.rows[key]

    def items(self):
        self.reads += 1
        return [(k, json.loads(v)) for k, v in self.rows.items()]

    def clear(self):
        self.rows = {}


def stores():
    return {k: Counted() for k in ("core", "levels", "index", "recent", "pending", "own")}


class BigTrades(StreamRule):
    """Every third trade above a size; remembers how many there were."""

    name, severity = "big_trade", 2

    def start(self):
        return {"n": 0}

    def on_trade(self, state, view, ts, side, price, qty):
        if qty < 3 * SCALE:
            return []
        state["n"] += 1
        return [(0.25, {"n": state["n"], "bids": view.book.depth(BUY)})] if state["n"] % 3 == 0 else []


class Thin(StreamRule):
    """A message that leaves few bids."""

    name, severity = "thin", 1

    def on_depth(self, state, view, ts, snapshot, changes):
        return [(0.5, {"changes": len(changes)})] if changes and view.book.depth(BUY) <= 4 else []


@pytest.mark.parametrize("seed", range(6))
def test_batches_do_not_matter(seed):
    r = random.Random(seed)
    rows = [SimpleNamespace(**x) for x in random_rows(seed, 900) if x["symbol"] == "A"]
    rules = (BigTrades(), Thin())
    whole = SymbolState(CFG, rules)
    want = [x for row in rows for x in whole.event(row)]
    kept, got, at = stores(), [], 0
    while at < len(rows):
        keeper = Keeper(kept, CFG, rules)  # nothing but the stores goes from batch to batch
        state = keeper.load()
        n = r.choice((1, 2, 7, 40))
        got += [x for row in rows[at : at + n] for x in state.event(row)]
        keeper.save(state)
        at += n
    assert got == want and {"big_trade", "thin"} < {x[3] for x in want}
    assert len(kept["recent"].rows) < 20 and json.loads(kept["own"].rows["big_trade",])[0] == json.dumps(whole.own["big_trade"])


@pytest.mark.parametrize("seed", range(8))
def test_bucket_ladder_is_the_ladder(seed):
    r = random.Random(seed)
    levels, index, head, plain = Counted(), Counted(), None, Ladder()
    tick = r.choice((1, 10**6, 7))
    far = r.choice((20, 3000, 40000))
    for _ in range(60):
        ladder = BucketLadder(levels, index, head)
        for _ in range(r.randint(1, 8)):
            n = r.choice((1, 3, 50, 900))
            price = lambda: (10**5 + r.randint(-far, far)) * tick
            message = [(r.randint(0, 1), price(), r.choice((0, 0, 1, 5))) for _ in range(n)]
            snapshot = r.random() < 0.04
            assert ladder.apply(snapshot, message) == plain.apply(snapshot, message)
            for side in (BUY, SELL):
                assert ladder.top(side, 7) == plain.top(side, 7) and ladder.depth(side) == plain.depth(side)
            assert ladder.mid() == plain.mid()
        ladder.flush()
        head = json.loads(json.dumps(ladder.head()))
    sizes = [len(json.loads(v)[0]) for v in levels.rows.values()]
    assert sum(sizes) == plain.depth(BUY) + plain.depth(SELL) and max(sizes, default=0) <= 4 * FULL


def test_only_what_is_touched_is_written():
    """A book of 200,000 levels: a batch near the best prices reads and writes some buckets, not the book."""
    kept = stores()
    keeper = Keeper(kept, Config())
    state = keeper.load()
    ts = 10**12
    side = lambda at, step: [{"p": at + k * step, "q": SCALE} for k in range(100_000)]
    row = lambda k, **x: SimpleNamespace(**({"seq": k, "ts_ns": ts + k * MS, "ingest_ns": ts, "kind": "depth", "is_snapshot": False, "side": None, "price_raw": None, "qty_raw": None, "bids": [], "asks": []} | x))
    state.event(row(0, is_snapshot=True, bids=side(10**10, -1000), asks=side(10**10 + 1000, 1000)))
    keeper.save(state)
    buckets = len(kept["levels"].rows)
    assert 100 < buckets < 200_000 / 8
    for s in kept.values():
        s.reads = s.writes = 0
    keeper = Keeper(kept, Config())
    state = keeper.load()
    out = []
    for k in range(1, 400):
        out += state.event(row(k, bids=[{"p": 10**10 - k % 50 * 1000, "q": (k % 3) * SCALE}]))
    keeper.save(state)
    assert out and kept["levels"].writes <= 4 and kept["levels"].reads <= 8 and kept["index"].writes == 0
    assert sum(s.writes for s in kept.values()) < 20 and len(kept["core"].rows[()]) < 600


def test_idle_windows_are_dropped():
    kept = stores()
    for k in range(30):
        keeper = Keeper(kept, Config())
        state = keeper.load()
        state.event(SimpleNamespace(seq=k, ts_ns=10**12 + k * 10 * SEC, ingest_ns=0, kind="trade", side=BUY, price_raw=SCALE, qty_raw=SCALE, is_snapshot=False, bids=[], asks=[]))
        keeper.save(state)
    assert len(kept["recent"].rows) <= 2


def test_own_rules_on_a_stream(spark, tmp_path):
    """Files of two symbols; alerts of built-in and own rules are those of one pass in memory."""
    from tidewatch.sources.tape import stream_of, tape_of_rows, write_in_order
    from tidewatch.streaming import engine

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test's module
    rows = random_rows(2, 400)
    n = write_in_order(tape_of_rows(spark, rows), str(tmp_path / "in"), 90)
    assert 4 <= n <= 6
    rules = (BigTrades(), Thin())
    live = Metrics()
    spark.streams.addListener(live)
    q = engine.start(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "cp"), str(tmp_path / "alerts"), str(tmp_path / "features"), CFG, rules=rules)
    q.awaitTermination()
    assert q.exception() is None and q.recentProgress and len(q.recentProgress) >= n
    got = sorted((r.symbol, r.seq, r.detector, r.severity, round(r.score, 9), r.body) for r in spark.read.parquet(str(tmp_path / "alerts")).collect())
    states, want, vectors = {}, [], 0
    for x in rows:
        out = states.setdefault(x["symbol"], SymbolState(CFG, rules)).event(SimpleNamespace(**x))
        want += [(x["symbol"], y[0], y[3], y[4], round(y[6], 9), y[8]) for y in out if y[2] == "alert"]
        vectors += sum(y[2] == "features" for y in out)
    assert got == sorted(want) and {"big_trade", "thin", "spoofing"} <= {x[2] for x in got}
    assert spark.read.parquet(str(tmp_path / "features")).count() == vectors > 0
    for _ in range(100):  # reports come after the batch
        if live.totals["batches"] >= n:
            break
        time.sleep(0.2)
    spark.streams.removeListener(live)
    assert live.totals["events"] == len(rows) and live.totals["alerts"] == len(want) and live.totals["features"] == vectors
    assert all(live.totals[f"alerts_{d}"] == sum(x[2] == d for x in want) for d in ("big_trade", "thin", "spoofing", "wash_trade"))
    assert live.detection == {str(b): len(want) for b in LATENCY_BOUNDS} | {"+Inf": len(want)}  # the tape's times are those of its events
    assert live.processing["+Inf"] == len(rows) and list(live.processing.values()) == sorted(live.processing.values())


def test_batches_are_counted_once():
    live = Metrics()
    for took in (1, 1, 400):
        live.add("run", took, 100, took, {"alerts": 3, "features": 1, "alerts_spoofing": 2, "detect_le_5": 1, "detect_le_10": 3})
    assert live.totals == {"events": 200, "batches": 2, "alerts": 6, "features": 2, "alerts_spoofing": 4}
    assert live.detection == {"5": 2, "10": 6, "+Inf": 6}
    assert live.processing["5"] == 0 and live.processing["10"] == 100 and live.processing["2500"] == 100 and live.processing["5000"] == 200


def test_models_on_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Uneven and empty batches, one of which comes again: decisions, alerts and their numbers are those of one plan over all samples."""
    from tidewatch.operators import anomaly
    from tidewatch.streaming.models import Scorer
    from tidewatch.types import FEATURES

    r = random.Random(5)
    rows = [(r.choice("AB"), k, k * SEC // 4, *(r.gauss(0, 1) * (12 if k % 23 == 0 else 1) for _ in FEATURES)) for k in range(1, 181)]
    schema = "symbol string, seq bigint, ts_ns bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    v = spark.createDataFrame(rows, schema).repartition(3)
    schedule = {"warmup": 40, "refit": 15, "buffer": 60}
    scorer = Scorer(str(tmp_path / "ml"), **schedule)
    cuts = [0, 25, 25, 47, 50, 130, 181]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for _ in range(2 if k in (3, 4) else 1):
            scorer(v.where(f"seq > {a} AND seq <= {b}"), k)
    seen = lambda d, *c: sorted(tuple(x[y] for y in c) for x in d.collect())
    got = spark.read.parquet(str(tmp_path / "ml" / "decisions"))
    assert seen(got, "n", "symbol", "seq", "version", "decision") == seen(anomaly.decisions(v, **schedule), "n", "symbol", "seq", "version", "decision") and got.count() == 140
    of = ("n", "id", "seq", "symbol", "score", "severity")
    alerts = seen(spark.read.parquet(str(tmp_path / "ml" / "alerts")), *of)
    assert alerts == seen(anomaly.alerts(v, **schedule), *of) and len({x[2] > 130 for x in alerts}) == 2
    assert sorted(p.name for p in (tmp_path / "ml" / "state" / "model").iterdir()) == ["batch=4", "batch=5"]


def test_scorer_behind_the_stream(spark, tmp_path):
    from tidewatch.operators import anomaly
    from tidewatch.operators.features import vectorized
    from tidewatch.sources.tape import stream_of, tape_of_rows, write_in_order
    from tidewatch.streaming import engine
    from tidewatch.streaming.models import Scorer

    n = write_in_order(tape_of_rows(spark, random_rows(3, 300)), str(tmp_path / "in"), 120)
    schedule = {"warmup": 12, "refit": 6, "buffer": 20}
    at = lambda x: str(tmp_path / x)
    q = engine.start(stream_of(spark, at("in")), at("cp"), at("alerts"), at("features"), CFG, observe=Scorer(at("ml"), **schedule).observe)
    q.awaitTermination()
    assert q.exception() is None and n >= 2
    from pyspark.sql import functions as F

    v = spark.read.parquet(at("features")).select("symbol", "seq", "ts_ns", F.from_json("body", "map<string,double>").alias("features"))
    want = {(x.symbol, x.seq): (x.n, x.version, x.decision) for x in anomaly.decisions(v, **schedule).collect()}
    got = {(x.symbol, x.seq): (x.n, x.version, x.decision) for x in spark.read.parquet(at("ml/decisions")).collect()}
    assert got == want and len(want) == vectorized(v).count() - 12 > 5


def test_levels_reach_the_workers_as_text(spark):
    """Packed and read back, a tape gives the rows that its structs give."""
    from tidewatch.streaming import engine

    tape = scripted_tape(spark)
    given = [r.asDict() for r in tape.orderBy("seq").collect()]
    packed = tape.orderBy("seq").select(engine._packed("bids").alias("bids"), engine._packed("asks").alias("asks")).collect()
    one, two = engine.SymbolState(Config()), engine.SymbolState(Config())
    for r, p in zip(given, packed, strict=True):
        assert isinstance(p.bids, str)
        assert one.event(SimpleNamespace(**r)) == two.event(SimpleNamespace(**r | p.asDict()))
    assert engine._unpacked("") == [] and engine._unpacked(None) == [] and engine._unpacked("-5,7;8,0") == [(-5, 7), (8, 0)]


def test_large_prices_are_exact_beside_nulls(spark, tmp_path):
    """Trades at a flagged price above 2^53 count as traded there, though depth messages have no price."""
    from tidewatch.sources.tape import stream_of, tape_of_rows, write_in_order
    from tidewatch.streaming import engine

    top, now, rows = 2**53 + 1, 10**12, []

    def put(**x):
        rows.append({"seq": len(rows), "ts_ns": now + len(rows) * 10 * MS, "ingest_ns": now, "symbol": "A", "exchange": "x", "kind": "depth", "is_snapshot": False, "side": None, "price_raw": None, "qty_raw": None, "first_id": None, "final_id": None, "bids": [], "asks": []} | x)

    put(is_snapshot=True, bids=[{"p": top - k, "q": SCALE} for k in (1, 2, 3)], asks=[{"p": top + 10, "q": SCALE}])
    for k in range(20):
        put(bids=[{"p": top - 9 - k, "q": SCALE}])
    put(bids=[{"p": top, "q": 40 * SCALE}])
    put(kind="trade", side=SELL, price_raw=top, qty_raw=20 * SCALE)
    put(bids=[{"p": top, "q": 0}])
    put(bids=[{"p": top - 100, "q": 40 * SCALE}])
    put(bids=[{"p": top - 100, "q": 0}])
    write_in_order(tape_of_rows(spark, rows), str(tmp_path / "in"), 100)
    q = engine.start(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "cp"), str(tmp_path / "alerts"), str(tmp_path / "features"), Config())
    q.awaitTermination()
    assert q.exception() is None
    assert [(r.seq, r.detector) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()] == [(25, "spoofing")]


def test_stores_follow_cores_and_lines_are_read_once(spark, tmp_path, capsys):
    """Many shuffle partitions make no store each, which every batch would open and write, and a line is parsed once."""
    from tidewatch.sources.tape import stream_of, tape_of_rows, write_in_order
    from tidewatch.streaming import engine

    write_in_order(tape_of_rows(spark, random_rows(4, 200)), str(tmp_path / "in"), 100)
    tape = stream_of(spark, str(tmp_path / "in"), 2)
    key, given = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "60")
    try:
        q = engine.start(tape, str(tmp_path / "cp"), str(tmp_path / "alerts"), str(tmp_path / "features"), CFG)
        assert spark.conf.get(key) == "60"
        q.awaitTermination()
    finally:
        spark.conf.set(key, given)
    assert q.exception() is None and q.lastProgress["stateOperators"][0]["numShufflePartitions"] == 4 * spark.sparkContext.defaultParallelism < 60
    capsys.readouterr()
    tape.explain()
    assert capsys.readouterr().out.count("from_json(") == 1


def test_blocks_hold_rows_in_order():
    """Blocks of tasks whose ranges overlap: a symbol's rows come by seq, some at a time, whatever the order of blocks; nulls stay nulls."""
    import pyarrow as pa

    from tidewatch.streaming import engine

    r = random.Random(2)
    rows = [{"symbol": r.choice(("A", "B", None)), "seq": k, "ts_ns": 2**60 + k, "ingest_ns": None if k == 7 else 2**60 + k, "kind": r.choice(("trade", "depth")), "is_snapshot": None, "side": 1, "price_raw": 2**53 + k, "qty_raw": k, "bids": "", "asks": None} for k in range(25_000)]
    r.shuffle(rows)
    rows += [{"symbol": "B", "seq": 25_000, "ts_ns": 1, "ingest_ns": 1, "kind": "depth", "is_snapshot": True, "side": None, "price_raw": None, "qty_raw": None, "bids": "1,2", "asks": ""}]
    schema = pa.schema([(c, pa.bool_() if c == "is_snapshot" else pa.string() if c in ("symbol", "kind", "bids", "asks") else pa.int64()) for c in rows[0]])
    tasks = [pa.Table.from_pylist(rows[at::3], schema).to_batches(700) for at in range(3)]
    blocks = [x for t in tasks for out in engine._blocks(iter(t)) for x in out.to_pylist()]
    assert len(blocks) == 9
    for symbol in ("A", "B", None):
        own = [x["rows"] for x in blocks if x["symbol"] == symbol]
        parts = list(engine._in_order(own[::-1]))
        assert max(b.num_rows for b in parts) <= engine._SLICE
        got = [(seq, ts, int(at) if at == at else None, trade, snapshot, side, price, qty, bids, asks) for b in parts for seq, ts, at, trade, snapshot, side, price, qty, bids, asks in engine._objects(b)]
        want = sorted((x for x in rows if x["symbol"] == symbol), key=lambda x: x["seq"])
        assert got == [(x["seq"], x["ts_ns"], x["ingest_ns"], x["kind"] == "trade", bool(x["is_snapshot"]), x["side"] or 0, x["price_raw"] or 0, x["qty_raw"] or 0, x["bids"], x["asks"]) for x in want]
    with pytest.raises(ValueError, match="price_raw"):
        engine._objects(pa.RecordBatch.from_pylist([{"kind": "trade", "side": 0, "price_raw": None, "qty_raw": 1}, {"kind": "trade", "side": 0, "price_raw": 2, "qty_raw": 1}]))
