"""Market tapes: from the ``events`` table, scripted, and from files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.types import BUY, MS, SCALE, SELL, TAPE

START_NS = 1_000_000_000_000
STEP_NS = 50 * MS
BASE = 30_000 * SCALE
TICK = SCALE // 100
SYMBOLS = 4
SNAPSHOT_EVERY = 2000

_BIDS = ", ".join(f"struct(bigint({BASE - k * TICK}) as p, bigint({10 * SCALE}) as q)" for k in range(3))
_ASKS = ", ".join(f"struct(bigint({BASE + 2 * TICK + k * TICK}) as p, bigint({10 * SCALE}) as q)" for k in range(3))


def tape_of_events(events: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """An ordered tape of trades and one-level depth messages, a fixed function of each event; users are dealt to ``symbols``.

    One snapshot a symbol comes first, and each event whose id ends a stretch of ``SNAPSHOT_EVERY`` is a snapshot too.
    """
    e = events.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    jump = (F.col("event_id") * 7919) % 7
    tick = (F.col("event_id") * 7919) % 3
    snap = F.col("event_id") % SNAPSHOT_EVERY == SNAPSHOT_EVERY - 1
    trade = F.col("event_type").isin("purchase", "click") & ~snap
    bid = (F.col("event_type") == "view") | ((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0))
    qty = F.when(F.col("event_id") % 4 == 0, F.lit(0)).otherwise(F.col("cents") * 1_000_000).cast("bigint")
    none = F.expr("cast(array() as array<struct<p:bigint,q:bigint>>)")
    level = lambda p: F.array(F.struct(p.cast("bigint").alias("p"), qty.alias("q")))
    rows = e.select(
        F.col("event_id").alias("seq"),
        (F.lit(START_NS) + F.col("event_id") * STEP_NS).alias("ts_ns"),
        (F.lit(START_NS) + F.col("event_id") * STEP_NS - (F.col("event_id") % 7) * 30_000).alias("ingest_ns"),
        F.concat(F.lit("SYM"), F.col("user_id") % symbols).alias("symbol"),
        F.lit("table").alias("exchange"),
        F.when(trade, "trade").otherwise("depth").alias("kind"),
        snap.alias("is_snapshot"),
        F.when(trade, F.when(F.col("event_type") == "purchase", BUY).otherwise(SELL)).alias("side"),
        F.when(trade, F.lit(BASE) + jump * SCALE * F.when(F.col("user_id") % 2 == 0, 1).otherwise(10)).cast("bigint").alias("price_raw"),
        F.when(trade, F.col("cents") * 100_000).cast("bigint").alias("qty_raw"),
        F.col("event_id").alias("first_id"),
        F.col("event_id").alias("final_id"),
        F.when(snap, F.expr(f"array({_BIDS})")).when(~trade & bid, level(F.lit(BASE) - tick * TICK)).otherwise(none).alias("bids"),
        F.when(snap, F.expr(f"array({_ASKS})")).when(~trade & ~bid, level(F.lit(BASE + 2 * TICK) + tick * TICK)).otherwise(none).alias("asks"),
    )
    first = events.sparkSession.range(symbols).select(
        (F.col("id") - symbols).alias("seq"),
        (F.lit(START_NS) + (F.col("id") - symbols) * STEP_NS).alias("ts_ns"),
        (F.lit(START_NS) + (F.col("id") - symbols) * STEP_NS).alias("ingest_ns"),
        F.concat(F.lit("SYM"), F.col("id")).alias("symbol"),
        F.lit("table").alias("exchange"),
        F.lit("depth").alias("kind"),
        F.lit(True).alias("is_snapshot"),
        F.lit(None).cast("int").alias("side"),
        F.lit(None).cast("bigint").alias("price_raw"),
        F.lit(None).cast("bigint").alias("qty_raw"),
        (F.col("id") - symbols).alias("first_id"),
        (F.col("id") - symbols).alias("final_id"),
        F.expr(f"array({_BIDS})").alias("bids"),
        F.expr(f"array({_ASKS})").alias("asks"),
    )
    return rows.unionByName(first)


def read_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _raw(text: str) -> int:
    whole, _, part = text.partition(".")
    return int(whole) * SCALE + int(part.ljust(8, "0") or 0)


def scripted_rows(symbol: str = "BTCUSDT") -> list[dict]:
    """A tape on which every rule fires: snapshot, quiet adds, a spoof, three layers, an ignition, stuffing, wash trades.

    Fixed values: prices, sizes and gaps in milliseconds.
    """
    rows: list[dict] = []
    now = START_NS

    def put(**x) -> None:
        rows.append({"seq": len(rows), "ts_ns": now, "ingest_ns": now, "symbol": symbol, "exchange": "script", "is_snapshot": False, "side": None, "price_raw": None, "qty_raw": None, "first_id": None, "final_id": None, "bids": [], "asks": []} | x)

    def depth(bids: list[tuple[int, str]], asks: list[tuple[int, str]] = (), snapshot: bool = False) -> None:
        put(kind="depth", is_snapshot=snapshot, bids=[{"p": p, "q": _raw(q)} for p, q in bids], asks=[{"p": p, "q": _raw(q)} for p, q in asks])

    def trade(price: str, qty: str, side: int) -> None:
        put(kind="trade", side=side, price_raw=_raw(price), qty_raw=_raw(qty))

    top = _raw("30000")
    depth([(top - k * TICK, "1") for k in range(5)], [(top + (2 + k) * TICK, "1") for k in range(5)], True)
    for k in range(20):
        now += 5 * MS
        depth([(_raw("29999.50") - k * TICK, "1")])
    now += 800 * MS
    depth([(top, "30")])
    now += 1000 * MS
    depth([(top, "1")])
    now += 600 * MS
    for k in range(3):
        depth([(top - k * TICK, "30")])
    now += 700 * MS
    for k in range(3):
        now += 15 * MS if k else 0
        depth([(top - k * TICK, "1")])
    now += 700 * MS
    for k, price in enumerate(("30000", "30015", "30030", "30046")):
        now += 120 * MS if k else 0
        trade(price, "2", BUY)
    now += 300 * MS
    trade("30022", "3", SELL)
    now += 4500 * MS
    for k in range(5):
        now += 50 * MS if k else 0
        depth([(_raw("29000") + (50 * k + i) * TICK, "1") for i in range(50)])
    now += 8000 * MS
    for k in range(8):
        now += 100 * MS if k else 0
        trade("30000.01" if k % 2 else "30000", "0.5", SELL if k % 2 else BUY)
    return rows


def tape_of_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in _COLUMNS) for r in rows], TAPE)


_COLUMNS = [c.strip() for c in TAPE.replace("<p:bigint,q:bigint>", "").split(",")]


def scripted_tape(spark: SparkSession, symbol: str = "BTCUSDT") -> DataFrame:
    return tape_of_rows(spark, scripted_rows(symbol))


def restamped(tape: DataFrame, speed: float, start_ns: int) -> DataFrame:
    """Playback at another speed: gaps are divided by ``speed`` (1 if not positive) and times start anew."""
    speed = speed if speed > 0 else 1.0
    first = tape.agg(F.min("ts_ns")).first()[0]
    return tape.withColumn("ts_ns", F.lit(start_ns) + ((F.col("ts_ns") - F.lit(first)) / speed).cast("bigint")).withColumn("ingest_ns", F.col("ts_ns"))


def write_in_order(tape: DataFrame, path: str, rows_per_file: int = 500_000) -> int:
    """Write a tape as JSON lines in files that ``stream_of`` reads in the order of seq; returns how many files there are.

    One shuffle by ranges of seq, one file a range. Spark reads files of a stream by their time, and tasks end in any order, so files
    get times a millisecond apart in the order of what they hold. Where the file system keeps no such times, each is copied in turn.
    """
    spark = tape.sparkSession
    n = max(1, -(-tape.count() // rows_per_file))
    lines = tape.repartitionByRange(n, "seq").sortWithinPartitions("seq").select(F.to_json(F.struct("*")).alias("value"))
    lines.write.text(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    # Tasks name their files by partition, and partitions are ranges in order.
    files = sorted((f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    last = max(t for _, t in files)
    times = [last - len(files) + k for k in range(len(files))]
    for (name, _), t in zip(files, times, strict=True):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(at, name), t, -1)
    if [fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(at, name)).getModificationTime() for name, _ in files] != times:
        util = jvm.org.apache.hadoop.fs.FileUtil
        for name, _ in files:
            src = jvm.org.apache.hadoop.fs.Path(at, name)
            util.copy(fs, src, fs, jvm.org.apache.hadoop.fs.Path(at, f"in-order-{name}"), True, conf)
    return len(files)


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """JSON lines of a tape as a stream; malformed lines are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    # A generator is read once; a plain column would be read again for each condition.
    rows = lines.select(F.inline(F.array(F.from_json("value", TAPE, {"mode": "PERMISSIVE"}))))
    return rows.where("symbol IS NOT NULL AND seq IS NOT NULL")
