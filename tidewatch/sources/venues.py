"""Frames of two venues' public feeds, normalised to tape rows with expressions only. Field names are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fixedpoint import parse
from tidewatch.types import BUY, SELL

_ROWS = "array<array<string>>"
_NONE = "cast(null as array<struct<p:bigint,q:bigint>>)"


def _levels(rows: Column) -> Column:
    """Levels of [price, size, ...] rows; null if one is short or not a number."""
    each = F.transform(F.coalesce(rows, F.expr(f"cast(array() as {_ROWS})")), lambda r: F.when(F.size(r) >= 2, F.struct(parse(F.get(r, F.lit(0))).alias("p"), parse(F.get(r, F.lit(1))).alias("q"))))
    bad = lambda x: x.isNull() | x["p"].isNull() | x["q"].isNull()
    return F.get(F.filter(F.array(each), lambda rows: ~F.exists(rows, bad)), F.lit(0))  # names ``each``, so that it is worked out once


def _out(df: DataFrame, venue: str, *, kind: Column, symbol: Column, snapshot: Column, side: Column, price: Column, qty: Column, trade_id: Column, first: Column, final: Column, bids: Column, asks: Column, ts: Column, error: Column) -> DataFrame:
    return df.select(
        "seq", "ingest_ns", F.lit(venue).alias("exchange"), kind.alias("kind"), symbol.alias("symbol"), snapshot.alias("is_snapshot"), side.alias("side"), price.alias("price_raw"), qty.alias("qty_raw"),
        trade_id.alias("trade_id"), first.alias("first_id"), final.alias("final_id"), bids.alias("bids"), asks.alias("asks"), ts.alias("exchange_ts_ms"), error.alias("error"),
    )


def binance(frames: DataFrame) -> DataFrame:
    """(seq, ingest_ns, raw) -> tape rows; frames of other kinds are skipped, and those that can't be read carry an error.

    Each object is read once, key by key, so keys that differ only in case stay apart.
    """
    keys = ("e", "E", "s", "U", "u", "b", "a", "t", "p", "q", "T", "m")
    at = lambda key: F.col(f"k{keys.index(key)}")
    f = frames.select("seq", "ingest_ns", "raw", F.json_tuple("raw", "data").alias("data"))
    f = f.select("seq", "ingest_ns", "raw", "data", F.json_tuple("data", *keys).alias(*(f"k{i}" for i in range(len(keys)))))
    json = F.trim("raw").startswith("{") & (F.col("data").isNotNull() | F.from_json("raw", "map<string,string>").isNotNull())
    broken = F.when(~F.coalesce(json, F.lit(False)), F.lit("not JSON"))
    f = f.withColumns({"e": at("e"), "broken": broken}).where("broken IS NOT NULL OR e IN ('depthUpdate', 'trade')")
    depth, trade = F.col("e") == "depthUpdate", F.col("e") == "trade"
    f = f.withColumns({f"l{k}": F.when(depth, _levels(F.from_json(F.coalesce(at(k), F.lit("[]")), _ROWS))) for k in "ba"} | {k: F.when(trade, parse(at(k))) for k in "pq"})
    bids, asks, price, qty = F.col("lb"), F.col("la"), F.col("p"), F.col("q")
    error = F.coalesce("broken", F.when(depth & (bids.isNull() | asks.isNull()), "bad level").when(trade & (price.isNull() | qty.isNull()), "bad trade"))
    num = lambda k: at(k).try_cast("bigint")
    return _out(
        f, "binance", kind=F.when(depth, "depth").when(trade, "trade"), symbol=at("s"), snapshot=F.lit(False), side=F.when(trade, F.when(at("m") == "true", SELL).otherwise(BUY)),
        price=F.when(trade, price), qty=F.when(trade, qty), trade_id=F.when(trade, num("t")), first=F.when(depth, num("U")), final=F.when(depth, num("u")),
        bids=F.when(depth, bids), asks=F.when(depth, asks), ts=F.when(trade, num("T")).otherwise(num("E")), error=error,
    )


def binance_snapshots(answers: DataFrame) -> DataFrame:
    """(seq, ingest_ns, symbol, raw) -> snapshot rows from answers of the depth service."""
    at = lambda key: F.get_json_object("raw", f"$.{key}")
    bids, asks = (_levels(F.from_json(F.coalesce(at(k), F.lit("[]")), _ROWS)) for k in ("bids", "asks"))
    nil = F.lit(None)
    return _out(
        answers, "binance", kind=F.lit("depth"), symbol=F.col("symbol"), snapshot=F.lit(True), side=nil.cast("int"), price=nil.cast("bigint"), qty=nil.cast("bigint"), trade_id=nil.cast("bigint"),
        first=nil.cast("bigint"), final=at("lastUpdateId").try_cast("bigint"), bids=bids, asks=asks, ts=nil.cast("bigint"), error=F.when(bids.isNull() | asks.isNull(), "bad level"),
    )


_ITEMS = 1000
_OKX_BOOK = "array<struct<asks:array<array<string>>,bids:array<array<string>>,ts:string,checksum:int,seqId:bigint,prevSeqId:bigint>>"
_OKX_TRADE = "array<struct<instId:string,tradeId:string,px:string,sz:string,side:string,ts:string>>"


def _okx(frames: DataFrame, channel: str, schema: str) -> DataFrame:
    f = frames.where("raw <> 'pong'").select("seq", "ingest_ns", F.json_tuple("raw", "event", "action", "arg", "data").alias("event", "action", "arg", "data"))
    f = f.where("event IS NULL").select("seq", "ingest_ns", "action", "data", F.json_tuple("arg", "channel", "instId").alias("channel", "inst")).where(F.col("channel") == channel)
    return f.select("seq", "ingest_ns", "inst", "action", F.posexplode(F.from_json("data", schema)).alias("item", "d"))


def _place() -> Column:
    """Place of an item in the order of all items: a frame may hold ``_ITEMS``; more is an error, as places would meet."""
    item = F.when(F.col("item") < _ITEMS, F.col("item")).otherwise(F.raise_error(F.lit(f"a frame holds more than {_ITEMS} items")))
    return F.col("seq") * _ITEMS + item


def okx_books(frames: DataFrame) -> DataFrame:
    """Items of book pushes with the venue's strings: what ``sync.continuity`` reads."""
    b = _okx(frames, "books", _OKX_BOOK)
    return b.select(_place().alias("seq"), "ingest_ns", F.col("inst").alias("symbol"), "action", F.col("d.prevSeqId").alias("prev_id"), F.col("d.seqId").alias("last_id"), F.coalesce("d.checksum", F.lit(0)).alias("checksum"), "d.bids", "d.asks", "d.ts")


def okx(frames: DataFrame) -> DataFrame:
    """(seq, ingest_ns, raw) -> tape rows of the items of book and trade pushes; trades that can't be read are left out."""
    b, nil = okx_books(frames), F.lit(None)
    b = b.withColumns({"bids": _levels(F.col("bids")), "asks": _levels(F.col("asks"))})
    bids, asks = F.col("bids"), F.col("asks")
    book = _out(
        b, "okx", kind=F.lit("depth"), symbol=F.col("symbol"), snapshot=F.coalesce(F.col("action") == "snapshot", F.lit(False)), side=nil.cast("int"), price=nil.cast("bigint"), qty=nil.cast("bigint"), trade_id=nil.cast("bigint"),
        first=F.col("prev_id"), final=F.col("last_id"), bids=bids, asks=asks, ts=F.coalesce(F.col("ts").try_cast("bigint"), F.lit(0)), error=F.when(bids.isNull() | asks.isNull(), "bad level"),
    )
    t = _okx(frames, "trades", _OKX_TRADE).withColumn("seq", _place())
    price, qty = parse(F.col("d.px")), parse(F.col("d.sz"))
    trade = _out(
        t.where(price.isNotNull() & qty.isNotNull()), "okx", kind=F.lit("trade"), symbol=F.col("d.instId"), snapshot=F.lit(False), side=F.when(F.col("d.side") == "sell", SELL).otherwise(BUY), price=price, qty=qty,
        trade_id=F.coalesce(F.col("d.tradeId").try_cast("bigint"), F.lit(0)), first=nil.cast("bigint"), final=nil.cast("bigint"), bids=F.expr(_NONE), asks=F.expr(_NONE), ts=F.coalesce(F.col("d.ts").try_cast("bigint"), F.lit(0)), error=nil.cast("string"),
    )
    return book.unionByName(trade)


def okx_errors(frames: DataFrame) -> DataFrame:
    """Error events of the venue: seq, code, msg."""
    at = lambda key: F.get_json_object("raw", f"$.{key}")
    return frames.where(at("event") == "error").select("seq", at("code").alias("code"), at("msg").alias("msg"))


def union(*feeds: DataFrame) -> DataFrame:
    """Feeds of several venues as one."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out
