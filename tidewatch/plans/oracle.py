"""The same results in DuckDB's SQL, set-based or recursive, from the ``events`` table."""

from __future__ import annotations

from tidewatch.operators.sync import BUFFER
from tidewatch.sources.tape import BASE, SNAPSHOT_EVERY, START_NS, STEP_NS, SYMBOLS, TICK
from tidewatch.types import DESCRIPTIONS, EMA_ALPHA, LATENCY_BOUNDS, SCALE, SEC, SEVERITIES, SEVERITY, TABLE_CONFIG as C

_S = f"{float(SCALE)}::DOUBLE"
LOST_EVERY = 211  # of the diffs of a feed, those with such an id are lost on the way


def real(x: str) -> str:
    return f"(({x})::DOUBLE / {_S})"


def _window(length: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts_ns RANGE BETWEEN {length} PRECEDING AND CURRENT ROW)"


def _thin(name: str, rows: str, wait: int) -> str:
    return f"""
{name}_at AS (
  SELECT symbol, min(ts_ns) AS ts_ns FROM {rows} WHERE ts_ns >= {wait} GROUP BY symbol
  UNION ALL
  SELECT r.symbol, min(r.ts_ns) FROM {name}_at f JOIN {rows} r ON r.symbol = f.symbol AND r.ts_ns >= f.ts_ns + {wait} GROUP BY r.symbol
), {name} AS MATERIALIZED (SELECT r.* FROM {rows} r JOIN {name}_at USING (symbol, ts_ns))"""


_DIFFS = f"""diffs AS (
  SELECT seq, ts_ns, symbol, CASE WHEN event_type = 'view' OR (event_type = 'signup' AND event_id % 2 = 0) THEN 0 ELSE 1 END AS side, (event_id * 7919) % 3 AS tick,
    CASE WHEN event_id % 4 = 0 THEN 0 ELSE cents * 1000000 END::BIGINT AS qty_raw
  FROM ev WHERE event_type NOT IN ('purchase', 'click') AND NOT snap
)"""

CTES = f"""
ev AS (
  SELECT event_id AS seq, {START_NS} + event_id * {STEP_NS} AS ts_ns, {START_NS} + event_id * {STEP_NS} - (event_id % 7) * 30000 AS ingest_ns, 'SYM' || (user_id % {SYMBOLS}) AS symbol,
    event_type, user_id, event_id, round(value * 100)::BIGINT AS cents, event_id % {SNAPSHOT_EVERY} = {SNAPSHOT_EVERY - 1} AS snap FROM events
), trades AS MATERIALIZED (
  SELECT seq, ts_ns, symbol, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS side,
    {BASE} + ((event_id * 7919) % 7) * {SCALE} * (CASE WHEN user_id % 2 = 0 THEN 1 ELSE 10 END) AS price_raw, cents * 100000 AS qty_raw
  FROM ev WHERE event_type IN ('purchase', 'click') AND NOT snap
), snaps AS (
  SELECT seq, ts_ns, symbol FROM ev WHERE snap UNION ALL SELECT k - {SYMBOLS}, {START_NS} + (k - {SYMBOLS}) * {STEP_NS}, 'SYM' || k FROM range({SYMBOLS}) r(k)
), {_DIFFS}, levels AS MATERIALIZED (
  SELECT seq, ts_ns, symbol, false AS is_snapshot, 0 AS pos, side, CASE WHEN side = 0 THEN {BASE} - tick * {TICK} ELSE {BASE + 2 * TICK} + tick * {TICK} END AS price_raw, qty_raw FROM diffs
  UNION ALL
  SELECT seq, ts_ns, symbol, true, k::INTEGER, CASE WHEN k < 3 THEN 0 ELSE 1 END, CASE WHEN k < 3 THEN {BASE} - k * {TICK} ELSE {BASE + 2 * TICK} + (k - 3) * {TICK} END, {10 * SCALE} FROM snaps, range(6) r(k)
), ep AS MATERIALIZED (
  SELECT seq, ts_ns, symbol, is_snapshot, sum(is_snapshot::BIGINT) OVER (PARTITION BY symbol ORDER BY seq)::BIGINT AS epoch
  FROM (SELECT seq, ts_ns, symbol, false AS is_snapshot FROM diffs UNION ALL SELECT seq, ts_ns, symbol, true FROM snaps)
), lv AS MATERIALIZED (SELECT l.*, epoch FROM levels l JOIN ep USING (symbol, seq) WHERE epoch > 0),
deltas AS MATERIALIZED (
  SELECT seq, ts_ns, symbol, epoch, pos, side, price_raw, old_raw, qty_raw AS new_raw, qty_raw > old_raw AS added
  FROM (SELECT *, coalesce(lag(qty_raw) OVER (PARTITION BY symbol, epoch, side, price_raw ORDER BY seq, pos), 0) AS old_raw FROM lv) WHERE NOT is_snapshot AND old_raw <> qty_raw
), iv AS (
  SELECT symbol, epoch, side, price_raw, qty_raw, seq AS a, lead(seq, 1, {2**62}) OVER (PARTITION BY symbol, epoch, side, price_raw ORDER BY seq, pos) AS b FROM lv
), lad AS MATERIALIZED (
  SELECT m.symbol, m.seq, side, price_raw, qty_raw, row_number() OVER (PARTITION BY m.symbol, m.seq, side ORDER BY CASE WHEN side = 0 THEN -price_raw ELSE price_raw END) AS rank
  FROM ep m JOIN iv i ON i.symbol = m.symbol AND i.epoch = m.epoch AND i.a <= m.seq AND m.seq < i.b WHERE qty_raw <> 0
), state AS MATERIALIZED (
  SELECT m.symbol, m.seq, m.ts_ns, max(price_raw) FILTER (side = 0 AND rank = 1) AS bid_raw, max(qty_raw) FILTER (side = 0 AND rank = 1) AS bid_qty_raw,
    max(price_raw) FILTER (side = 1 AND rank = 1) AS ask_raw, max(qty_raw) FILTER (side = 1 AND rank = 1) AS ask_qty_raw,
    coalesce(sum(qty_raw) FILTER (side = 0 AND rank <= 5), 0)::BIGINT AS bid_top_raw, coalesce(sum(qty_raw) FILTER (side = 1 AND rank <= 5), 0)::BIGINT AS ask_top_raw,
    count(*) FILTER (side = 0) AS bid_depth, count(*) FILTER (side = 1) AS ask_depth
  FROM ep m LEFT JOIN lad USING (symbol, seq) WHERE epoch > 0 GROUP BY m.symbol, m.seq, m.ts_ns
), priced AS MATERIALIZED (
  SELECT *, ({real("bid_raw")} + {real("ask_raw")}) / 2 AS mid,
    CASE WHEN {real("bid_qty_raw")} + {real("ask_qty_raw")} = 0 THEN ({real("bid_raw")} + {real("ask_raw")}) / 2
      ELSE ({real("bid_raw")} * {real("ask_qty_raw")} + {real("ask_raw")} * {real("bid_qty_raw")}) / ({real("bid_qty_raw")} + {real("ask_qty_raw")}) END AS micro,
    ask_raw - bid_raw AS spread_raw,
    CASE WHEN bid_top_raw + ask_top_raw > 0 THEN ({real("bid_top_raw")} - {real("ask_top_raw")}) / ({real("bid_top_raw")} + {real("ask_top_raw")}) ELSE 0.0::DOUBLE END AS ofi
  FROM state
), wash_w AS (
  SELECT *, count(*) OVER w AS n, max(price_raw) OVER w AS hi_raw, min(price_raw) OVER w AS lo_raw,
    coalesce(sum(qty_raw) FILTER (side = 0) OVER w, 0)::BIGINT AS buy_raw, coalesce(sum(qty_raw) FILTER (side = 1) OVER w, 0)::BIGINT AS sell_raw
  FROM trades WINDOW w AS {_window(C.wash_window)}
), wash_m AS (
  SELECT *, ({real("hi_raw")} - {real("lo_raw")}) / (({real("hi_raw")} + {real("lo_raw")}) / 2) * 1e4::DOUBLE AS band_bps, {real("buy_raw + sell_raw")} AS volume,
    CASE WHEN buy_raw + sell_raw > 0 THEN {real("least(buy_raw, sell_raw)")} / {real("buy_raw + sell_raw")} ELSE 0.0::DOUBLE END AS balance FROM wash_w
), wash_c AS MATERIALIZED (
  SELECT * FROM wash_m WHERE n >= {C.wash_min_trades} AND band_bps <= {C.wash_band_bps}::DOUBLE AND balance >= {C.wash_balance}::DOUBLE AND volume >= {C.wash_min_volume}::DOUBLE
), {_thin("wash_a", "wash_c", C.wash_cooldown)},
churned AS (SELECT symbol, seq, count(*) OVER {_window(C.stuff_window)} AS churn FROM deltas),
marks AS (
  SELECT seq, ts_ns, symbol, is_trade, sum(is_trade) OVER {_window(C.stuff_window)}::BIGINT AS n_trades
  FROM (SELECT seq, ts_ns, symbol, 1 AS is_trade FROM trades UNION ALL SELECT seq, ts_ns, symbol, 0 FROM diffs)
), stuff_w AS MATERIALIZED (
  SELECT seq, ts_ns, symbol, n_trades, coalesce(last_value(churn IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS churn
  FROM marks LEFT JOIN churned USING (symbol, seq) WHERE is_trade = 0
), stuff_c AS MATERIALIZED (SELECT * FROM stuff_w WHERE churn >= {C.stuff_churn} AND n_trades <= {C.stuff_max_trades}),
{_thin("stuff_a", "stuff_c", C.stuff_cooldown)},
mom_w AS MATERIALIZED (
  SELECT *, first_value(price_raw) OVER w AS start_raw, max(price_raw) OVER w AS hi_raw, min(price_raw) OVER w AS lo_raw,
    sum(CASE WHEN side = 0 THEN qty_raw ELSE -qty_raw END) OVER w::BIGINT AS net_raw, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS k
  FROM trades WINDOW w AS {_window(C.ignite_window)}
), mom_x AS MATERIALIZED (
  SELECT symbol, k, seq, ts_ns, {real("price_raw")} AS price, {real("start_raw")} AS s, {real("hi_raw")} AS hi, {real("lo_raw")} AS lo, {real("net_raw")} AS net FROM mom_w
), mom_r AS (
  SELECT symbol, 0::BIGINT AS k, 0::BIGINT AS seq, 0::BIGINT AS ts_ns, -1 AS dir, 0.0::DOUBLE AS leg_start, 0.0::DOUBLE AS leg_peak, 0::BIGINT AS since, false AS fired, -1 AS fdir, 0.0::DOUBLE AS price FROM (SELECT DISTINCT symbol FROM mom_x)
  UNION ALL
  SELECT symbol, k, seq, ts_ns,
    CASE WHEN dir = -1 THEN CASE WHEN up THEN 0 WHEN down THEN 1 ELSE -1 END WHEN late OR hit THEN -1 ELSE dir END,
    CASE WHEN dir = -1 THEN s ELSE leg_start END,
    CASE WHEN dir = -1 THEN CASE WHEN up THEN hi ELSE lo END ELSE peak END,
    CASE WHEN dir = -1 OR moved THEN ts_ns ELSE since END,
    dir <> -1 AND NOT late AND hit, dir, price
  FROM (
    SELECT *, CASE WHEN dir = 0 THEN price <= peak - {C.reverse_share}::DOUBLE * (peak - leg_start) ELSE price >= peak - {C.reverse_share}::DOUBLE * (peak - leg_start) END AS hit
    FROM (
      SELECT x.*, r.dir, r.leg_start, r.since, x.ts_ns - r.since > {C.reverse_window} AS late,
        (r.dir = 0 AND x.price > r.leg_peak) OR (r.dir = 1 AND x.price < r.leg_peak) AS moved,
        CASE WHEN (r.dir = 0 AND x.price > r.leg_peak) OR (r.dir = 1 AND x.price < r.leg_peak) THEN x.price ELSE r.leg_peak END AS peak,
        (x.hi - x.s) / x.s * 1e4::DOUBLE >= {C.ignite_bps}::DOUBLE AND x.net >= {C.ignite_volume}::DOUBLE AS up,
        -((x.lo - x.s) / x.s * 1e4::DOUBLE) >= {C.ignite_bps}::DOUBLE AND -x.net >= {C.ignite_volume}::DOUBLE AS down
      FROM mom_r r JOIN mom_x x ON x.symbol = r.symbol AND x.k = r.k + 1
    )
  )
), mom_a AS MATERIALIZED (
  SELECT symbol, seq, ts_ns, fdir AS side, leg_start, leg_peak, price, (leg_peak - leg_start) / leg_start * 1e4::DOUBLE AS leg_bps, (price - leg_peak) / leg_peak * 1e4::DOUBLE AS retrace_bps FROM mom_r WHERE fired
), ema_x AS MATERIALIZED (
  SELECT d.symbol, d.seq, d.ts_ns, pos, side, price_raw, new_raw, added, mid, {real("new_raw")} AS size, row_number() OVER (PARTITION BY d.symbol ORDER BY d.seq, pos) AS k,
    coalesce(abs(({real("price_raw")} - mid) / mid * 1e4::DOUBLE) <= {C.spoof_max_bps}::DOUBLE, false) AS near
  FROM deltas d LEFT JOIN priced USING (symbol, seq)
), ema_r AS (
  SELECT symbol, 0::BIGINT AS k, false AS flagged, 0.0::DOUBLE AS typical, 0::BIGINT AS samples FROM (SELECT DISTINCT symbol FROM ema_x)
  UNION ALL
  SELECT symbol, k, flag, CASE WHEN NOT added OR flag THEN typical WHEN samples = 0 THEN size ELSE typical + {EMA_ALPHA}::DOUBLE * (size - typical) END, CASE WHEN NOT added OR flag THEN samples ELSE samples + 1 END
  FROM (
    SELECT x.symbol, x.k, x.added, x.size, r.typical, r.samples, x.added AND x.near AND r.samples >= {C.spoof_min_samples} AND x.size >= {C.spoof_multiple}::DOUBLE * r.typical AS flag
    FROM ema_r r JOIN ema_x x ON x.symbol = r.symbol AND x.k = r.k + 1
  )
), flags AS MATERIALIZED (SELECT symbol, seq, ts_ns, pos, side, price_raw, new_raw, added, flagged, typical, samples FROM ema_x JOIN ema_r USING (symbol, k)),
pull_f AS (
  SELECT *, last_value(CASE WHEN flagged THEN seq END IGNORE NULLS) OVER w AS flag_seq, last_value(CASE WHEN flagged THEN ts_ns END IGNORE NULLS) OVER w AS flag_ts, last_value(CASE WHEN flagged THEN new_raw END IGNORE NULLS) OVER w AS flag_raw
  FROM flags WINDOW w AS (PARTITION BY symbol, side, price_raw ORDER BY seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), pull_q AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, side, price_raw, flag_seq ORDER BY seq, pos) AS k FROM pull_f
  WHERE NOT added AND flag_seq IS NOT NULL AND ts_ns - flag_ts <= {C.spoof_window} AND {real("new_raw")} <= (1 - {C.spoof_pull}::DOUBLE) * {real("flag_raw")}
), pulls AS MATERIALIZED (
  SELECT symbol, seq, ts_ns, pos, side, price_raw, typical, flag_seq, flag_ts, flag_raw, traded_raw
  FROM (SELECT q.*, coalesce((SELECT sum(t.qty_raw) FROM trades t WHERE t.symbol = q.symbol AND t.price_raw = q.price_raw AND t.seq > q.flag_seq AND t.seq < q.seq), 0)::BIGINT AS traded_raw FROM pull_q q WHERE k = 1)
  WHERE {real("traded_raw")} <= {C.spoof_max_traded}::DOUBLE * {real("flag_raw")}
), {_thin("spoof_a", "pulls", C.spoof_cooldown)},
layer_w AS MATERIALIZED (
  SELECT p.symbol, p.seq, p.ts_ns, p.pos, p.side, p.price_raw, (SELECT count(DISTINCT o.price_raw) FROM pulls o WHERE o.symbol = p.symbol AND o.side = p.side AND o.ts_ns BETWEEN p.ts_ns - {C.layering_window} AND p.ts_ns)::INTEGER AS n_levels FROM pulls p
), layer_c AS MATERIALIZED (SELECT * FROM layer_w WHERE n_levels >= {C.layering_levels}),
{_thin("layer_a", "layer_c", C.layering_cooldown)},
raised AS MATERIALIZED (
  SELECT seq, ts_ns, symbol, 'spoofing' AS detector, 0 AS rule, pos, 0 AS last, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {real("flag_raw")} / ({C.spoof_multiple}::DOUBLE * typical) / 3)) AS score FROM spoof_a
  UNION ALL SELECT seq, ts_ns, symbol, 'layering', 0, pos, 1, greatest(0.0::DOUBLE, least(1.0::DOUBLE, n_levels / {float(C.layering_levels)}::DOUBLE / 2)) FROM layer_a
  UNION ALL SELECT seq, ts_ns, symbol, 'momentum_ignition', 2, 0, 0, greatest(0.0::DOUBLE, least(1.0::DOUBLE, abs(leg_bps) / {2 * C.ignite_bps}::DOUBLE)) FROM mom_a
  UNION ALL SELECT seq, ts_ns, symbol, 'quote_stuffing', 3, 0, 0, greatest(0.0::DOUBLE, least(1.0::DOUBLE, churn / {float(2 * C.stuff_churn)}::DOUBLE)) FROM stuff_a
  UNION ALL SELECT seq, ts_ns, symbol, 'wash_trade', 4, 0, 0, greatest(0.0::DOUBLE, least(1.0::DOUBLE, balance)) FROM wash_a
), alerts AS MATERIALIZED (
  SELECT symbol || '-' || detector || '-' || n AS id, n, seq, ts_ns, detector, symbol, severity, CASE severity {" ".join(f"WHEN {k} THEN '{v}'" for k, v in SEVERITIES.items())} END AS severity_label, score,
    CASE detector {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DESCRIPTIONS.items())} END AS description, greatest(0, (ts_ns - ingest_ns) // 1000) AS detect_latency_us
  FROM (SELECT r.*, ingest_ns, row_number() OVER (ORDER BY seq, rule, pos, last) AS n, CASE detector {" ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY.items())} END AS severity FROM raised r JOIN ev USING (symbol, seq, ts_ns))
), every AS MATERIALIZED (
  SELECT seq, ts_ns, symbol, 1 AS t, CASE WHEN side = 1 THEN -qty_raw ELSE qty_raw END AS v, 0 AS c, 0 AS r FROM trades
  UNION ALL SELECT m.seq, m.ts_ns, m.symbol, 0, 0, CASE WHEN d.seq IS NULL THEN 0 ELSE 1 END, CASE WHEN NOT d.added THEN 1 ELSE 0 END FROM ep m LEFT JOIN deltas d USING (symbol, seq)
), flow AS MATERIALIZED (
  SELECT seq, ts_ns, symbol, sum(t) OVER w::BIGINT AS trades, sum(v) OVER w::BIGINT AS volume_raw, sum(c) OVER w::BIGINT AS changes, sum(r) OVER w::BIGINT AS removals FROM every WINDOW w AS {_window(C.feature_window)}
), feat_k AS (
  SELECT f.*, row_number() OVER w AS k, last_value(p.seq IGNORE NULLS) OVER w AS book_seq FROM flow f LEFT JOIN priced p USING (symbol, seq) WINDOW w AS (PARTITION BY f.symbol ORDER BY f.seq ROWS UNBOUNDED PRECEDING)
), vectors AS MATERIALIZED (
  SELECT f.symbol, f.seq, f.ts_ns, {real("spread_raw")} / mid * 1e4::DOUBLE AS spread_bps, ofi, (micro - mid) / mid * 1e4::DOUBLE AS microprice_dev_bps, trades / {C.feature_window / SEC}::DOUBLE AS trade_intensity,
    {real("volume_raw")} AS signed_vol, CASE WHEN changes > 0 THEN removals::DOUBLE / changes ELSE 0.0::DOUBLE END AS cancel_ratio, bid_depth::DOUBLE AS bid_depth, ask_depth::DOUBLE AS ask_depth
  FROM feat_k f JOIN priced p ON p.symbol = f.symbol AND p.seq = f.book_seq WHERE k % {C.feature_every} = 0 AND mid IS NOT NULL AND mid <> 0
), entries AS MATERIALIZED (
  SELECT n AS seq, ts_ns, '{{"id":"' || id || '","detector":"' || detector || '","latency":' || detect_latency_us || '}}' AS payload FROM alerts
), hashes AS (
  SELECT 0::BIGINT AS seq, 0::BIGINT AS ts_ns, '' AS payload, '' AS prev_hash, '{"00" * 32}' AS hash
  UNION ALL
  SELECT e.seq, e.ts_ns, e.payload, h.hash, sha256(encode('tidewatch.audit.entry.v1') || unhex(printf('%016x', e.seq)) || unhex(printf('%016x', e.ts_ns)) || unhex(printf('%08x', octet_length(encode(e.payload)))) || encode(e.payload) || unhex(h.hash))
  FROM hashes h JOIN entries e ON e.seq = h.seq + 1
)
"""


def sql(select: str, ctes: str = CTES) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


#: As a venue sends it: diffs that are lost, and those after one up to the next snapshot of the symbol, don't count.
FEED = CTES.replace(_DIFFS, f"""sent AS (
  SELECT *, seq % {LOST_EVERY} = 0 AS lost FROM (SELECT * FROM ({_DIFFS.removeprefix("diffs AS (").removesuffix(")")}))
), received AS (
  SELECT *, sum(lost::INTEGER) OVER (PARTITION BY symbol, epoch ORDER BY seq) AS holes FROM (
    SELECT s.*, (SELECT count(*) FROM snaps p WHERE p.symbol = s.symbol AND p.seq < s.seq) AS epoch FROM sent s)
), diffs AS (SELECT * EXCLUDE (lost, epoch, holes) FROM received WHERE epoch > 0 AND holes = 0)""")

#: Every depth message of a symbol in turn. Update ids are event ids here, so a snapshot is newer than all that waits for it.
_SYNC = f"""sync_x AS MATERIALIZED (SELECT symbol, seq, is_snapshot, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS k FROM ep
), sync_r AS (
  SELECT symbol, 0::BIGINT AS k, NULL::BIGINT AS seq, ''::VARCHAR AS outcome, NULL::BIGINT AS upto, 0::BIGINT AS held, 0::BIGINT AS resyncs, 0::BIGINT AS dropped FROM (SELECT DISTINCT symbol FROM sync_x)
  UNION ALL
  SELECT symbol, k, seq, outcome, CASE outcome WHEN 'gap' THEN NULL WHEN 'buffered' THEN NULL WHEN 'stale' THEN upto ELSE seq END,
    CASE outcome WHEN 'gap' THEN 1 WHEN 'buffered' THEN least(held + 1, {BUFFER}) ELSE 0 END, resyncs + CASE outcome WHEN 'gap' THEN 1 ELSE 0 END, dropped + CASE WHEN outcome = 'buffered' AND held = {BUFFER} THEN 1 ELSE 0 END
  FROM (
    SELECT x.symbol, x.k, x.seq, r.upto, r.held, r.resyncs, r.dropped, CASE WHEN is_snapshot THEN 'synced' WHEN r.upto IS NULL THEN 'buffered' WHEN x.seq <= r.upto THEN 'stale' WHEN x.seq > r.upto + 1 THEN 'gap' ELSE 'apply' END AS outcome
    FROM sync_r r JOIN sync_x x ON x.symbol = r.symbol AND x.k = r.k + 1)
)"""


_BOUNDS = " UNION ALL ".join(f"SELECT '{b}' AS le, count(*) FILTER (detect_latency_us <= {b}) AS n FROM alerts" for b in LATENCY_BOUNDS)

#: Queries by name -> what is selected from the tables above.
SELECTS = {
    "tape_trades": "SELECT * FROM trades",
    "tape_levels": "SELECT * FROM levels",
    "fixedpoint_parse": "SELECT event_id, (CASE WHEN event_id % 2 = 1 THEN -1 ELSE 1 END) * (event_id * 100000000 + (event_id * 7919) % 100000000) AS raw FROM events",
    "fixedpoint_format": "SELECT seq, price_raw, qty_raw, (price_raw // 100000000)::VARCHAR AS price, CASE WHEN qty_raw % 100000000 = 0 THEN (qty_raw // 100000000)::VARCHAR ELSE (qty_raw // 100000000)::VARCHAR || '.' || rtrim(lpad((qty_raw % 100000000)::VARCHAR, 8, '0'), '0') END AS qty FROM trades",
    "notional_mul": "SELECT seq, (price_raw // 10000) * (qty_raw // 10000) AS notional_raw FROM trades",
    "book_epochs": "SELECT * FROM ep",
    "level_deltas": "SELECT * FROM deltas",
    "top_of_book": "SELECT symbol, seq, ts_ns, bid_raw, bid_qty_raw, ask_raw, ask_qty_raw FROM state",
    "mid_micro_spread": "SELECT symbol, seq, mid, micro, spread_raw FROM priced",
    "topn_depth_imbalance": "SELECT symbol, seq, bid_top_raw, ask_top_raw, ofi FROM priced",
    "book_depth_counts": "SELECT symbol, seq, bid_depth, ask_depth FROM state",
    "final_ladder": "SELECT symbol, side, rank::INTEGER AS rank, price_raw, qty_raw FROM lad JOIN (SELECT symbol, max(seq) AS seq FROM ep GROUP BY symbol) USING (symbol, seq)",
    "sliding_trade_window": "SELECT seq, symbol, n, hi_raw, lo_raw, buy_raw, sell_raw, band_bps, volume, balance FROM wash_m",
    "window_span": f"SELECT symbol, seq, ts_ns - min(ts_ns) OVER {_window(C.wash_window)} AS span_ns FROM trades",
    "flow_windows": "SELECT * FROM flow",
    "distinct_in_window": "SELECT symbol, seq, side, n_levels FROM layer_w",
    "spoof_ema_flags": "SELECT * FROM flags",
    "spoof_pulls": "SELECT * FROM pulls",
    "spoof_alerts": "SELECT * FROM spoof_a",
    "layering_alerts": "SELECT * FROM layer_a",
    "momentum_windows": "SELECT seq, symbol, start_raw, hi_raw, lo_raw, net_raw FROM mom_w",
    "momentum_alerts": "SELECT * FROM mom_a",
    "stuffing_windows": "SELECT * FROM stuff_w",
    "stuffing_alerts": "SELECT seq, ts_ns, symbol, churn, n_trades FROM stuff_a",
    "wash_candidates": "SELECT seq, symbol, n, band_bps, volume, balance FROM wash_c",
    "wash_alerts": "SELECT seq, ts_ns, symbol, n, band_bps, volume, balance FROM wash_a",
    "all_alerts": "SELECT * FROM alerts",
    "feature_vectors": "SELECT * FROM vectors",
    "alerts_by_detector": "SELECT detector, count(*) AS n FROM alerts GROUP BY detector",
    "alerts_by_severity": "SELECT severity_label, count(*) AS n FROM alerts GROUP BY severity_label",
    "alerts_grouping_sets": "SELECT detector, severity_label, count(*) AS n FROM alerts GROUP BY GROUPING SETS ((detector), (severity_label), ())",
    "alert_stats": "SELECT count(*) AS total, count(*) FILTER (severity >= 3) AS urgent, floor(count(*) / 600.0::DOUBLE * 60 * 100 + 0.5::DOUBLE) / 100 AS alerts_per_min FROM alerts",
    "streamed_alerts": "SELECT symbol, seq, ts_ns, detector, severity, severity_label, score, detect_latency_us FROM alerts",
    "alert_feed": "SELECT n, id FROM alerts ORDER BY n DESC LIMIT 300",
    "recent_alerts": "SELECT * FROM alerts ORDER BY n DESC LIMIT 100",
    "latest_tile": f"""SELECT symbol, {real("price_raw")} AS last_price, t.ts_ns AS last_trade_ts_ns, spread_bps, ofi, trade_intensity, cancel_ratio, v.ts_ns AS feature_ts_ns
FROM (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1) t FULL JOIN (SELECT * FROM vectors QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1) v USING (symbol)""",
    "latency_histogram": f"{_BOUNDS} UNION ALL SELECT '+Inf', count(*) FROM alerts",
    "venue_counters": "SELECT 'table' AS exchange, (SELECT count(*) FROM trades) + (SELECT count(*) FROM ep) AS received, (SELECT count(*) FROM trades) AS trades, (SELECT count(*) FROM diffs) AS depth, (SELECT count(*) FROM snaps) AS snapshots",
    "sequence_gaps": "SELECT symbol, seq, seq AS first_id, expected_id FROM (SELECT symbol, seq, lag(seq) OVER (PARTITION BY symbol ORDER BY seq) + 1 AS expected_id FROM diffs) WHERE seq <> expected_id",
    "stale_diff_filter": """SELECT symbol, seq, first_id, final_id FROM (SELECT symbol, seq, seq AS first_id, seq - seq % 5 * 40 AS final_id, max(seq - seq % 5 * 40) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM diffs)
WHERE b IS NULL OR final_id > b""",
    "checksum_payload": f"""SELECT symbol, string_agg((price_raw / {float(SCALE)}::DOUBLE)::DECIMAL(20, 2)::VARCHAR || ':' || qty_raw::VARCHAR, ':' ORDER BY rank, side) AS payload
FROM lad JOIN (SELECT symbol, max(seq) AS seq FROM ep GROUP BY symbol) USING (symbol, seq) WHERE rank <= 25 GROUP BY symbol""",
    "subject_match": "SELECT DISTINCT 'md.' || symbol AS subject, symbol = 'SYM1' AS exact, true AS any_symbol, false AS any_deeper, true AS rest FROM ev",
    "symbol_shard": "SELECT symbol, count(*) AS n FROM (SELECT symbol FROM trades UNION ALL SELECT symbol FROM ep) WHERE symbol = 'SYM2' GROUP BY symbol",
    "binance_trades": "SELECT seq, symbol, side, price_raw, qty_raw, ts_ns // 1000000 AS exchange_ts_ms FROM trades",
    "binance_depth": "SELECT seq, symbol, side, price_raw, qty_raw, seq + 1 AS final_id FROM levels WHERE NOT is_snapshot",
    "okx_trades": "SELECT seq * 1000 AS seq, symbol, side, price_raw, qty_raw, ts_ns // 1000000 AS exchange_ts_ms, seq AS trade_id FROM trades",
    "okx_books": "SELECT seq * 1000 AS seq, symbol, side, price_raw, qty_raw, seq AS final_id FROM levels WHERE NOT is_snapshot",
    "hash_chain": "SELECT * FROM hashes WHERE seq > 0",
    "hash_chain_verify": "SELECT seq AS at, seq, 'hash mismatch' AS reason FROM hashes WHERE seq > 0 AND seq % 50 = 7",
    "published_symbols": "SELECT symbol, kind, count(*) AS n, max(seq) AS last_seq FROM (SELECT symbol, 'trade' AS kind, seq FROM trades UNION ALL SELECT symbol, 'depth', seq FROM ep) WHERE symbol IN ('SYM1', 'SYM3') GROUP BY symbol, kind",
    "custom_rules": f"SELECT 'wash_trade' AS detector, 'low' AS severity_label, count(*) AS n FROM wash_a UNION ALL SELECT 'wide_spread', 'low', count(*) FROM priced WHERE spread_raw > {3 * SCALE // 100}",
    "ml_refit_schedule": "SELECT symbol, seq, n, CASE WHEN n <= 150 THEN 0 ELSE (n - 151) // 100 + 1 END AS version FROM (SELECT symbol, seq, row_number() OVER (ORDER BY seq) AS n FROM vectors)",
}

_PAIRS = "unhex(h) || unhex(lead(h) OVER (PARTITION BY k ORDER BY i))"


def _level(n: int) -> str:
    """Nodes of the next level of each group: a hash of two, or an odd one as it is."""
    return f"""l{n + 1} AS (SELECT k, (i + 1) // 2 AS i, CASE WHEN pair IS NULL THEN h ELSE sha256('\\x01'::BLOB || pair) END AS h
  FROM (SELECT k, i, h, {_PAIRS} AS pair FROM l{n}) WHERE i % 2 = 1)"""


MERKLE = f"""SELECT from_seq, to_seq, n, h AS merkle_root FROM (
  WITH l0 AS (SELECT (seq - 1) // 16 AS k, (seq - 1) % 16 + 1 AS i, sha256('\\x00'::BLOB || unhex(hash)) AS h FROM hashes WHERE seq > 0), {", ".join(map(_level, range(4)))}
  SELECT * FROM l4) JOIN (SELECT (seq - 1) // 16 AS k, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS n FROM hashes WHERE seq > 0 GROUP BY 1) USING (k)"""
SELECTS["merkle_roots"] = MERKLE

ORACLE_SQL = {name: sql(select) for name, select in SELECTS.items()}
ORACLE_SQL["feed_sync"] = sql("""SELECT seq, symbol, 'trade' AS kind, false AS is_snapshot, ts_ns, 0 AS n_bids, 0 AS n_asks FROM trades
UNION ALL SELECT seq, symbol, 'depth', false, ts_ns, 1 - side, side FROM diffs UNION ALL SELECT seq, symbol, 'depth', true, ts_ns, 3, 3 FROM snaps""", FEED)
ORACLE_SQL["feed_alerts"] = sql("SELECT id, n, ts_ns, detector, symbol, severity_label, score FROM alerts", FEED)
ORACLE_SQL["book_sync"] = sql("SELECT symbol, seq, outcome, CASE WHEN outcome IN ('synced', 'apply') THEN '[' || seq || ']' ELSE '[]' END AS passed, resyncs, dropped FROM sync_r WHERE k > 0", f"{CTES}, {_SYNC}")
ORACLE_SQL["synchronized_tape"] = sql("""SELECT symbol, seq, 'depth' AS kind, seq AS release_seq, 0 AS release_pos FROM sync_r WHERE outcome IN ('synced', 'apply')
UNION ALL SELECT symbol, seq, 'trade', seq, 0 FROM trades""", f"{CTES}, {_SYNC}")

ORACLE_SQL["ingest_stats"] = sql("""SELECT 'table' AS exchange, (SELECT count(*) FROM trades) + (SELECT count(*) FROM ep) AS received, (SELECT count(*) FROM trades) AS trades, (SELECT count(*) FROM diffs) AS depth,
  (SELECT count(*) FROM snaps) AS snapshots, count(*) FILTER (outcome IN ('apply', 'synced')) AS applied, count(*) FILTER (outcome = 'stale') AS stale, count(*) FILTER (outcome IN ('buffered', 'gap')) AS buffered,
  count(*) FILTER (outcome = 'gap') AS gaps, 0::BIGINT AS again, (SELECT sum(d)::BIGINT FROM (SELECT max(dropped) AS d FROM sync_r GROUP BY symbol)) AS dropped FROM sync_r WHERE k > 0""", f"{CTES}, {_SYNC}")


def _round4(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE)"


#: What each rule shows, by field, from the rows of its alerts.
_EVIDENCE = (
    ("spoof_a", "spoofing", {
        "typical_qty": _round4("typical"), "size_multiple": _round4(f"({real('flag_raw')} / typical)"), "lifetime_ms": _round4("((ts_ns - flag_ts)::DOUBLE / 1e6::DOUBLE)"),
        "flagged_qty": real("flag_raw"), "traded_qty": real("traded_raw"), "price": real("price_raw"),
    }),
    ("layer_a", "layering", {"levels_pulled": "n_levels::DOUBLE", "window_ms": f"{C.layering_window / 10**6}::DOUBLE"}),
    ("mom_a", "momentum_ignition", {"leg_bps": _round4("leg_bps"), "retrace_bps": _round4("retrace_bps"), "leg_start": _round4("leg_start"), "leg_peak": _round4("leg_peak"), "reverse_price": _round4("price")}),
    ("stuff_a", "quote_stuffing", {"updates_in_window": "churn::DOUBLE", "trades_in_window": "n_trades::DOUBLE", "window_ms": f"{C.stuff_window / 10**6}::DOUBLE"}),
    ("wash_a", "wash_trade", {"trades": "n::DOUBLE", "band_bps": _round4("band_bps"), "volume": _round4("volume"), "side_balance": _round4("balance")}),
)
ORACLE_SQL["alert_evidence"] = sql("SELECT n, a.detector, field, value FROM alerts a JOIN (" + " UNION ALL ".join(
    f"SELECT symbol, seq, '{d}' AS detector, {'pos' if t in ('spoof_a', 'layer_a') else '0'} AS pos, '{f}' AS field, {x} AS value FROM {t}" for t, d, fields in _EVIDENCE for f, x in fields.items()
) + ") e ON e.symbol = a.symbol AND e.seq = a.seq AND e.detector = a.detector")
ORACLE_SQL["routed_subjects"] = """WITH taken AS (
  SELECT 'user-' || user_id AS sink, event_id FROM events WHERE user_id % 7 = 0 UNION ALL SELECT 'kind-' || event_type, event_id FROM events UNION ALL SELECT 'all', event_id FROM events
  UNION ALL SELECT 'late', event_id FROM events UNION ALL SELECT 'first', event_id FROM events WHERE user_id % 4 = 0 UNION ALL SELECT 'exact', event_id FROM events WHERE user_id = 3 AND event_type = 'view'
) SELECT sink, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM taken GROUP BY sink"""

#: The alerts of the scripted tape, which needs no table.
ORACLE_SQL["scripted_alerts"] = """SELECT id, n::BIGINT AS n, seq::BIGINT AS seq, ts_ns::BIGINT AS ts_ns, detector, symbol, severity::INTEGER AS severity, severity_label,
  score::DOUBLE AS score, description, detect_latency_us::BIGINT AS detect_latency_us, evidence FROM (VALUES
  ('BTCUSDT-spoofing-1', 1, 22, 1001900000000, 'spoofing', 'BTCUSDT', 3, 'high', 1.0, 'large resting order near the touch pulled before it traded', 0, '{"side":"buy","price":"30000","flagged_qty":"30","typical_qty":1.0,"size_multiple":30.0,"lifetime_ms":1000.0,"traded_qty":"0"}'),
  ('BTCUSDT-spoofing-2', 2, 26, 1003200000000, 'spoofing', 'BTCUSDT', 3, 'high', 1.0, 'large resting order near the touch pulled before it traded', 0, '{"side":"buy","price":"30000","flagged_qty":"30","typical_qty":1.0,"size_multiple":30.0,"lifetime_ms":700.0,"traded_qty":"0"}'),
  ('BTCUSDT-layering-3', 3, 28, 1003230000000, 'layering', 'BTCUSDT', 4, 'critical', 0.5, 'several large orders stacked on one side pulled together', 0, '{"side":"buy","levels_pulled":3,"window_ms":4000.0}'),
  ('BTCUSDT-momentum_ignition-4', 4, 33, 1004590000000, 'momentum_ignition', 'BTCUSDT', 3, 'high', 0.5111111111111112, 'one-sided aggressive burst followed by a fast reversal', 0, '{"direction":"buy","leg_bps":15.3333,"retrace_bps":-7.9878,"leg_start":30000.0,"leg_peak":30046.0,"reverse_price":30022.0}'),
  ('BTCUSDT-quote_stuffing-5', 5, 38, 1009290000000, 'quote_stuffing', 'BTCUSDT', 2, 'medium', 0.5, 'many book updates with next to no trades', 0, '{"updates_in_window":250,"trades_in_window":0,"window_ms":1000.0}'),
  ('BTCUSDT-wash_trade-6', 6, 44, 1017790000000, 'wash_trade', 'BTCUSDT', 1, 'low', 0.5, 'offsetting trades in a very thin band; a footprint only, ownership is unknown', 0, '{"trades":6,"band_bps":0.0033,"volume":3.0,"side_balance":0.5,"note":"footprint only: ownership is unknown"}')
) t(id, n, seq, ts_ns, detector, symbol, severity, severity_label, score, description, detect_latency_us, evidence)"""
