"""Units, thresholds and labels shared by all operators. Prices and sizes are 64-bit counts of 1e-8, times are nanoseconds."""

from __future__ import annotations

from dataclasses import dataclass

SCALE = 10**8
BUY, SELL = 0, 1
SIDES = ("buy", "sell")
MS, SEC = 10**6, 10**9

SEVERITIES = {1: "low", 2: "medium", 3: "high", 4: "critical"}
#: Rules in the order in which they see an event, with the severity of their alerts.
RULES = ("spoofing", "layering", "momentum_ignition", "quote_stuffing", "wash_trade")
SEVERITY = {"spoofing": 3, "layering": 4, "momentum_ignition": 3, "quote_stuffing": 2, "wash_trade": 1}
DESCRIPTIONS = {
    "spoofing": "large resting order near the touch pulled before it traded",
    "layering": "several large orders stacked on one side pulled together",
    "momentum_ignition": "one-sided aggressive burst followed by a fast reversal",
    "quote_stuffing": "many book updates with next to no trades",
    "wash_trade": "offsetting trades in a very thin band; a footprint only, ownership is unknown",
}
EMA_ALPHA = 0.05

#: The keys of a feature vector, in order.
FEATURES = ("spread_bps", "ofi", "microprice_dev_bps", "trade_intensity", "signed_vol", "cancel_ratio", "bid_depth", "ask_depth")
#: Upper bounds of the latency histogram in microseconds.
LATENCY_BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000)


@dataclass(frozen=True)
class Config:
    """Thresholds of the rules; the defaults are fixed values."""

    spoof_multiple: float = 6.0
    spoof_min_samples: int = 15
    spoof_window: int = 3 * SEC
    spoof_pull: float = 0.7
    spoof_max_traded: float = 0.2
    spoof_max_bps: float = 25.0
    spoof_cooldown: int = 1 * SEC
    layering_levels: int = 3
    layering_window: int = 4 * SEC
    layering_cooldown: int = 5 * SEC
    ignite_bps: float = 15.0
    ignite_volume: float = 5.0
    ignite_window: int = 1500 * MS
    reverse_share: float = 0.5
    reverse_window: int = 2500 * MS
    stuff_churn: int = 250
    stuff_max_trades: int = 3
    stuff_window: int = 1 * SEC
    stuff_cooldown: int = 5 * SEC
    wash_min_trades: int = 6
    wash_band_bps: float = 3.0
    wash_balance: float = 0.3
    wash_min_volume: float = 1.0
    wash_window: int = 2 * SEC
    wash_cooldown: int = 5 * SEC
    feature_levels: int = 5
    feature_window: int = 2 * SEC
    feature_every: int = 20


#: For the tape made of the ``events`` table, which is far thinner than a market's.
TABLE_CONFIG = Config(spoof_multiple=2.0, layering_levels=2, stuff_churn=4, stuff_max_trades=1)

LEVELS = "array<struct<p:bigint,q:bigint>>"
#: An ordered tape: trades carry side, price_raw and qty_raw; depth messages carry bids and asks.
TAPE = f"seq bigint, ts_ns bigint, ingest_ns bigint, symbol string, exchange string, kind string, is_snapshot boolean, side int, price_raw bigint, qty_raw bigint, first_id bigint, final_id bigint, bids {LEVELS}, asks {LEVELS}"
