"""Every operator as a query over the tape that the ``events`` table gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixedpoint as fp
from tidewatch.functions import subjects
from tidewatch.operators import anomaly, audit, book, dashboard, features, routing, rules, scan, sync
from tidewatch.operators.windows import sliding, span
from tidewatch.plans.oracle import LOST_EVERY
from tidewatch.scratch import scratch_path, written
from tidewatch.sources import sinks, venues
from tidewatch.sources.tape import read_tape, scripted_tape
from tidewatch.types import SCALE, TABLE_CONFIG, Config

CFG = TABLE_CONFIG


def _tape(f):
    """A query from a function of the tape."""
    return lambda spark, sf_dir: f(read_tape(spark, sf_dir))


def _alerts(tape: DataFrame) -> DataFrame:
    return rules.alerts(tape, CFG).drop("evidence")


def _unordered(tape: DataFrame) -> DataFrame:
    """Alerts for counts, which need no numbers."""
    return rules.alerts(tape, CFG, ordered=False)


#: Numbers in the evidence of each rule.
EVIDENCE = {
    "spoofing": ("typical_qty", "size_multiple", "lifetime_ms", "flagged_qty", "traded_qty", "price"), "layering": ("levels_pulled", "window_ms"), "momentum_ignition": ("leg_bps", "retrace_bps", "leg_start", "leg_peak", "reverse_price"),
    "quote_stuffing": ("updates_in_window", "trades_in_window", "window_ms"), "wash_trade": ("trades", "band_bps", "volume", "side_balance"),
}


def alert_evidence(tape: DataFrame) -> DataFrame:
    """The numbers that alerts give as evidence, one a row."""
    a = rules.alerts(tape, CFG)
    fields = F.create_map(*[x for d, names in EVIDENCE.items() for x in (F.lit(d), F.array(*map(F.lit, names)))])
    a = a.select("n", "detector", F.from_json("evidence", "map<string,string>").alias("e"), F.explode(fields[F.col("detector")]).alias("field"))
    return a.select("n", "detector", "field", F.col("e")[F.col("field")].cast("double").alias("value"))


def _vectors(tape: DataFrame) -> DataFrame:
    return features.vectors(tape, CFG)


def fixedpoint_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    part = F.lpad(((F.col("event_id") * 7919) % SCALE).cast("string"), 8, "0")
    text = F.concat(F.when(F.col("event_id") % 2 == 1, "-").otherwise("+"), F.col("event_id").cast("string"), F.lit("."), part, F.lit("99"))
    return e.select("event_id", fp.parse(text).alias("raw"))


def distinct_levels(tape: DataFrame) -> DataFrame:
    p = sliding(rules.pulls(tape, CFG), CFG.layering_window, ["seq", "pos"], {"near": lambda w: F.collect_set(F.struct("side", "price_raw")).over(w)})
    return p.select("symbol", "seq", "side", F.size(F.filter("near", lambda x: x["side"] == F.col("side"))).alias("n_levels"))


def subject_match(tape: DataFrame) -> DataFrame:
    s = tape.where("seq >= 0").select(subjects.market(F.col("symbol")).alias("subject")).distinct()
    return s.select("subject", *[subjects.matches(F.col("subject"), p).alias(n) for n, p in (("exact", "md.SYM1"), ("any_symbol", "md.*"), ("any_deeper", "md.*.extra"), ("rest", "md.>"))])


def routed_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by sink: a pattern for each seventh user, two for each kind of event, and some that take many subjects."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    subject = F.format_string("md.SYM%d.%s.%d", F.col("user_id") % 4, "event_type", "user_id")
    of = lambda sink, pattern: e.select(sink.alias("sink"), pattern.alias("pattern"))
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    wanted = of(F.concat(F.lit("user-"), user), F.concat(F.lit("md.*.*."), user)).where("user_id % 7 = 0").union(of(F.concat(F.lit("kind-"), kind), F.concat(F.lit("md.*."), kind, F.lit(".*"))))
    wanted = wanted.union(of(F.concat(F.lit("kind-"), kind), F.concat(F.lit("md.SYM1."), kind, F.lit(".>")))).distinct()
    wide = [("all", ">"), ("first", "md.SYM0.>"), ("none", "md.*"), ("exact", "md.SYM3.view.3"), ("late", "md.>.view")]
    out = routing.routed(e, subject, wanted.union(spark.createDataFrame(wide, "sink string, pattern string")))
    return out.select(F.explode("sinks").alias("sink"), "event_id").groupBy("sink").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def stale(tape: DataFrame) -> DataFrame:
    return sync.not_stale(tape.withColumn("final_id", F.col("seq") - F.col("seq") % 5 * 40))


def checksum(tape: DataFrame) -> DataFrame:
    l = book.last_levels(tape)
    l = l.withColumns({"price": (F.col("price_raw") / SCALE).cast("decimal(20,2)").cast("string"), "size": F.col("qty_raw").cast("string")})
    return sync.checksum_payload(l).select("symbol", "payload")


def binance_trades(tape: DataFrame) -> DataFrame:
    """Trades written as the venue's frames and read back."""
    t = tape.where("kind = 'trade'")
    ms = fp.idiv(F.col("ts_ns"), 1_000_000)
    raw = F.format_string(
        '{"stream":"%s@trade","data":{"e":"trade","E":%d,"s":"%s","t":%d,"p":"%s","q":"%s","T":%d,"m":%s}}',
        F.lower("symbol"), ms + 1, "symbol", "seq", fp.render(F.col("price_raw")), fp.render(F.col("qty_raw")), ms, F.when(F.col("side") == 1, "true").otherwise("false"),
    )
    return venues.binance(t.select("seq", "ingest_ns", raw.alias("raw"))).select("seq", "symbol", "side", "price_raw", "qty_raw", "exchange_ts_ms")


def okx_books(tape: DataFrame) -> DataFrame:
    """One-level diffs written as the venue's frames, read back and taken apart."""
    d = book.levels(tape).where("NOT is_snapshot")
    row = F.format_string('[["%s","%s","0","1"]]', fp.render(F.col("price_raw")), fp.render(F.col("qty_raw")))
    bids, asks = F.when(F.col("side") == 0, row).otherwise("[]"), F.when(F.col("side") == 1, row).otherwise("[]")
    raw = F.format_string('{"arg":{"channel":"books","instId":"%s"},"action":"update","data":[{"asks":%s,"bids":%s,"ts":"1","checksum":0,"seqId":%d,"prevSeqId":%d}]}', "symbol", asks, bids, "seq", F.col("seq") - 1)
    out = venues.okx(d.select("seq", F.lit(0).cast("bigint").alias("ingest_ns"), raw.alias("raw")))
    return _level_rows(out)


def _level_rows(messages: DataFrame) -> DataFrame:
    each = book.exploded(messages.where("kind = 'depth'").withColumn("ts_ns", F.col("exchange_ts_ms")), "final_id")
    return each.select("seq", "symbol", "side", "price_raw", "qty_raw", "final_id")


def binance_depth(tape: DataFrame) -> DataFrame:
    """One-level diffs written as the venue's frames, read back and taken apart."""
    d = book.levels(tape).where("NOT is_snapshot")
    row = F.format_string('[["%s","%s"]]', fp.render(F.col("price_raw")), fp.render(F.col("qty_raw")))
    bids, asks = F.when(F.col("side") == 0, row).otherwise("[]"), F.when(F.col("side") == 1, row).otherwise("[]")
    raw = F.format_string('{"stream":"%s@depth@100ms","data":{"e":"depthUpdate","E":1,"s":"%s","U":%d,"u":%d,"b":%s,"a":%s}}', F.lower("symbol"), "symbol", "seq", F.col("seq") + 1, bids, asks)
    return _level_rows(venues.binance(d.select("seq", F.lit(0).cast("bigint").alias("ingest_ns"), raw.alias("raw"))))


def okx_trades(tape: DataFrame) -> DataFrame:
    """Trades written as the venue's frames and read back."""
    t = tape.where("kind = 'trade'")
    item = F.format_string('{"instId":"%s","tradeId":"%d","px":"%s","sz":"%s","side":"%s","ts":"%d"}', "symbol", "seq", fp.render(F.col("price_raw")), fp.render(F.col("qty_raw")), F.when(F.col("side") == 1, "sell").otherwise("buy"), fp.idiv(F.col("ts_ns"), 1_000_000))
    raw = F.concat(F.lit('{"arg":{"channel":"trades","instId":"'), "symbol", F.lit('"},"data":['), item, F.lit("]}"))
    return venues.okx(t.select("seq", "ingest_ns", raw.alias("raw"))).where("kind = 'trade'").select("seq", "symbol", "side", "price_raw", "qty_raw", "exchange_ts_ms", "trade_id")


def _feed(tape: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tape as a venue sends it: frames, of which some diffs are lost, and answers of the snapshot service. Diffs of a symbol have
    update ids without holes, and a snapshot holds the id of the last diff before it. Frames come at the tape's time."""
    pairs = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit('["'), fp.render(x["p"]), F.lit('","'), fp.render(x["q"]), F.lit('"]'))), ","), F.lit("]"))
    ms = fp.idiv(F.col("ts_ns"), 1_000_000)
    d = scan.running(tape.where("kind = 'depth'"), ["symbol"], ["seq"], {"u": ("sum", (~F.col("is_snapshot")).cast("bigint"))}).withColumns({"b": pairs("bids"), "a": pairs("asks")})
    diff = F.format_string('{"stream":"%s@depth","data":{"e":"depthUpdate","E":%d,"s":"%s","U":%d,"u":%d,"b":%s,"a":%s}}', F.lower("symbol"), ms, "symbol", "u", "u", "b", "a")
    trade = F.format_string(
        '{"stream":"%s@trade","data":{"e":"trade","E":%d,"s":"%s","t":%d,"p":"%s","q":"%s","T":%d,"m":%s}}',
        F.lower("symbol"), ms, "symbol", "seq", fp.render(F.col("price_raw")), fp.render(F.col("qty_raw")), ms, F.when(F.col("side") == 1, "true").otherwise("false"),
    )
    at = F.col("ts_ns").alias("ingest_ns")
    frames = d.where(f"NOT is_snapshot AND seq % {LOST_EVERY} <> 0").select("seq", at, diff.alias("raw")).unionByName(tape.where("kind = 'trade'").select("seq", at, trade.alias("raw")))
    answer = F.format_string('{"lastUpdateId":%d,"bids":%s,"asks":%s}', F.coalesce("u", F.lit(0)), "b", "a")
    return frames, d.where("is_snapshot").select("seq", at, "symbol", answer.alias("raw"))


def _received(tape: DataFrame) -> DataFrame:
    """What of the feed passes the sequence check, in the order in which it passes."""
    frames, answers = _feed(tape)
    # Written, so that frames are read once and not for each of the branches, and the filter does not read them again.
    got = written(venues.union(venues.binance(frames), venues.binance_snapshots(answers)), "frames")
    return sync.released(got.where("error IS NULL").withColumn("ts_ns", F.col("ingest_ns")))


def feed_sync(tape: DataFrame) -> DataFrame:
    return _received(tape).select(F.col("origin_seq").alias("seq"), "symbol", "kind", "is_snapshot", "ts_ns", F.coalesce(F.size("bids"), F.lit(0)).alias("n_bids"), F.coalesce(F.size("asks"), F.lit(0)).alias("n_asks"))


def feed_alerts(tape: DataFrame) -> DataFrame:
    """Frames of a venue, the sequence check and all rules as one path."""
    got = written(_received(tape), "received")  # all rules read it
    return rules.alerts(got, CFG, latency=False).select("id", "n", "ts_ns", "detector", "symbol", "severity_label", "score")


def _chain(tape: DataFrame) -> DataFrame:
    body = F.format_string('{"id":"%s","detector":"%s","latency":%d}', "id", "detector", "detect_latency_us")
    return audit.chain(_alerts(tape).select("n", "ts_ns", body.alias("payload")))


def chain_verify(tape: DataFrame) -> DataFrame:
    """Faults of a chain in which some payloads were changed afterwards."""
    return audit.chain_faults(written(_chain(tape), "chain").withColumn("payload", F.when(F.col("seq") % 50 == 7, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))))


def streamed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the streaming engine over the same tape in files: they must be those of the batch plan."""
    from tidewatch.sources.tape import stream_of, write_in_order
    from tidewatch.streaming import engine

    base = scratch_path(spark, "stream")
    tape = read_tape(spark, sf_dir)
    n = tape.count()
    files = write_in_order(tape, f"{base}/tape", min(500_000, -(-n // 16)))
    # Four batches at least, of about two million rows at most: each costs some seconds besides its rows, and a symbol's must fit in memory.
    batches = max(4, -(-n // 2_000_000))
    run = engine.start(stream_of(spark, f"{base}/tape", -(-files // batches)), f"{base}/checkpoint", f"{base}/alerts", f"{base}/features", CFG)
    run.awaitTermination()
    return spark.read.parquet(f"{base}/alerts").select("symbol", "seq", "ts_ns", "detector", "severity", "severity_label", "score", "detect_latency_us")


def published_symbols(tape: DataFrame) -> DataFrame:
    """A tape written by symbol and read again for two symbols."""
    path = scratch_path(tape.sparkSession, "published")
    sinks.publish(tape, path)
    return sinks.published(tape.sparkSession, path, "sym1", "SYM3").groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def wide_spreads(tape: DataFrame, cfg: Config) -> DataFrame:
    """A rule of one's own: books whose spread is above two hundredths."""
    s = book.with_prices(book.state(tape)).where(F.col("spread_raw") > 3 * SCALE // 100)
    return s.select("seq", "ts_ns", "symbol", F.lit(0.5).alias("score"), F.to_json(F.struct("spread_raw")).alias("evidence"))


def custom_rules(tape: DataFrame) -> DataFrame:
    own = {"wide_spread": rules.Rule(wide_spreads, 1, "wide spread")}
    return rules.alerts(tape, CFG, only=("wash_trade",), extra=own).groupBy("detector", "severity_label").agg(F.count(F.lit(1)).alias("n"))


def rules_and_anomalies(tape: DataFrame) -> DataFrame:
    return sinks.all_alerts(rules.alerts(tape, CFG), anomaly.alerts(_vectors(tape)))


QUERIES = {
    "tape_trades": _tape(rules.trades),
    "tape_levels": _tape(book.levels),
    "fixedpoint_parse": fixedpoint_parse,
    "fixedpoint_format": _tape(lambda t: rules.trades(t).select("seq", "price_raw", "qty_raw", fp.render(F.col("price_raw")).alias("price"), fp.render(F.col("qty_raw")).alias("qty"))),
    "notional_mul": _tape(lambda t: rules.trades(t).select("seq", fp.notional(F.col("price_raw"), F.col("qty_raw")).alias("notional_raw"))),
    "book_epochs": _tape(book.epochs),
    "level_deltas": _tape(book.deltas),
    "top_of_book": _tape(lambda t: book.state(t).select("symbol", "seq", "ts_ns", "bid_raw", "bid_qty_raw", "ask_raw", "ask_qty_raw")),
    "mid_micro_spread": _tape(lambda t: book.with_prices(book.state(t)).select("symbol", "seq", "mid", "micro", "spread_raw")),
    "topn_depth_imbalance": _tape(lambda t: book.with_prices(book.state(t)).select("symbol", "seq", "bid_top_raw", "ask_top_raw", "ofi")),
    "book_depth_counts": _tape(lambda t: book.state(t).select("symbol", "seq", "bid_depth", "ask_depth")),
    "final_ladder": _tape(book.last_levels),
    "sliding_trade_window": _tape(lambda t: rules.wash_windows(t, CFG).select("seq", "symbol", "n", "hi_raw", "lo_raw", "buy_raw", "sell_raw", "band_bps", "volume", "balance")),
    "window_span": _tape(lambda t: sliding(rules.trades(t), CFG.wash_window, ["seq"], {"span_ns": span}).select("symbol", "seq", "span_ns")),
    "flow_windows": _tape(lambda t: features.flow_windows(t, CFG.feature_window)),
    "distinct_in_window": _tape(distinct_levels),
    "spoof_ema_flags": _tape(lambda t: rules.size_flags(t, CFG)),
    "spoof_pulls": _tape(lambda t: rules.pulls(t, CFG)),
    "spoof_alerts": _tape(lambda t: rules.spoofing(t, CFG)),
    "layering_alerts": _tape(lambda t: rules.layering(t, CFG)),
    "momentum_windows": _tape(lambda t: rules.momentum_windows(t, CFG).select("seq", "symbol", "start_raw", "hi_raw", "lo_raw", "net_raw")),
    "momentum_alerts": _tape(lambda t: rules.momentum_ignition(t, CFG)),
    "stuffing_windows": _tape(lambda t: rules.stuffing_windows(t, CFG)),
    "stuffing_alerts": _tape(lambda t: rules.quote_stuffing(t, CFG)),
    "wash_candidates": _tape(lambda t: rules.wash_candidates(t, CFG).select("seq", "symbol", "n", "band_bps", "volume", "balance")),
    "wash_alerts": _tape(lambda t: rules.wash_trades(t, CFG)),
    "all_alerts": _tape(_alerts),
    "feature_vectors": _tape(_vectors),
    "alerts_by_detector": _tape(lambda t: dashboard.by_detector(_unordered(t))),
    "alerts_by_severity": _tape(lambda t: dashboard.by_severity(_unordered(t))),
    "alerts_grouping_sets": _tape(lambda t: dashboard.totals(_unordered(t))),
    "alert_stats": _tape(lambda t: dashboard.stats(_unordered(t), 600.0)),
    "alert_feed": _tape(lambda t: dashboard.feed(_alerts(t)).select("n", "id")),
    "recent_alerts": _tape(lambda t: dashboard.recent(_alerts(t))),
    "latest_tile": _tape(lambda t: dashboard.tiles(t, _vectors(t))),
    "latency_histogram": _tape(lambda t: dashboard.latency_histogram(_unordered(t))),
    "venue_counters": _tape(dashboard.counters),
    "ingest_stats": _tape(dashboard.ingest_stats),
    "alert_evidence": _tape(alert_evidence),
    "sequence_gaps": _tape(sync.gaps),
    "stale_diff_filter": _tape(stale),
    "book_sync": _tape(lambda t: sync.synced(t).withColumn("passed", F.to_json("passed"))),
    "synchronized_tape": _tape(lambda t: sync.applied(t).select("symbol", "seq", "kind", "release_seq", "release_pos")),
    "feed_sync": _tape(feed_sync),
    "feed_alerts": _tape(feed_alerts),
    "checksum_payload": _tape(checksum),
    "subject_match": _tape(subject_match),
    "routed_subjects": routed_subjects,
    "symbol_shard": _tape(lambda t: subjects.only(t, "md.SYM2").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))),
    "binance_trades": _tape(binance_trades),
    "binance_depth": _tape(binance_depth),
    "okx_books": _tape(okx_books),
    "okx_trades": _tape(okx_trades),
    "hash_chain": _tape(_chain),
    "hash_chain_verify": _tape(chain_verify),
    "merkle_roots": _tape(lambda t: audit.merkle_roots(_chain(t), 16)),
    "ml_refit_schedule": _tape(lambda t: anomaly.schedule(_vectors(t)).select("symbol", "seq", "n", "version")),
    "ml_decisions": _tape(lambda t: anomaly.decisions(_vectors(t))),
    "ml_anomalies": _tape(lambda t: anomaly.alerts(_vectors(t))),
    "scripted_alerts": lambda spark, sf_dir: rules.alerts(scripted_tape(spark), Config()),
    "streamed_alerts": streamed_alerts,
    "published_symbols": _tape(published_symbols),
    "custom_rules": _tape(custom_rules),
    "rules_and_anomalies": _tape(rules_and_anomalies),
}
