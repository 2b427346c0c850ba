"""Live metrics of a stream: what its batches observe, added up by a listener on the driver."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidewatch.types import LATENCY_BOUNDS, RULES

NAME = "tidewatch"


def observed(out: DataFrame, rules: tuple[str, ...] = ()) -> DataFrame:
    """The engine's output with counts that travel with each batch: alerts, by rule and by detection latency, and features."""
    alert = F.col("kind") == "alert"
    count = lambda c, name: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(name)
    late = [count(alert & (F.col("detect_latency_us") <= b), f"detect_le_{b}") for b in LATENCY_BOUNDS]
    return out.observe(NAME, count(alert, "alerts"), count(~alert, "features"), *[count(alert & (F.col("detector") == r), f"alerts_{r}") for r in (*RULES, *rules)], *late)


class Metrics(StreamingQueryListener):
    """Totals over all batches of queries whose output is ``observed``. ``totals``: events, batches, alerts, features, alerts by rule;
    ``detection`` and ``processing``: cumulative histograms (bound -> count) of an alert's latency and of the time a batch takes an event.

    Register it with ``spark.streams.addListener``; batches are reported some moments after they end.
    """

    def __init__(self) -> None:
        self.totals: Counter[str] = Counter()
        self.detection: Counter[str] = Counter()
        self._per_event: list[int] = [0] * (len(LATENCY_BOUNDS) + 1)
        self._seen: set[tuple[str, int]] = set()

    @property
    def processing(self) -> dict[str, int]:
        upto, out = 0, {}
        for bound, n in zip([*map(str, LATENCY_BOUNDS), "+Inf"], self._per_event, strict=True):
            upto += n
            out[bound] = upto
        return out

    def add(self, run: str, batch: int, events: int, took_ms: int, found: dict[str, int]) -> None:
        """One batch; one that was reported before counts once."""
        if (run, batch) in self._seen or not events:
            return
        self._seen.add((run, batch))
        self.totals.update({"events": events, "batches": 1})
        for name, n in found.items():
            if name.startswith("detect_le_"):
                self.detection[name.removeprefix("detect_le_")] += n
            else:
                self.totals[name] += n
        self.detection["+Inf"] += found.get("alerts", 0)
        self._per_event[bisect_left(LATENCY_BOUNDS, took_ms * 1000 / events)] += events

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = p.observedMetrics.get(NAME)
        self.add(str(p.runId), p.batchId, p.numInputRows, (p.durationMs or {}).get("addBatch", 0), row.asDict() if row is not None else {})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
