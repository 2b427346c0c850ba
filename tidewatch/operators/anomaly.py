"""Unsupervised anomalies of feature vectors: isolation forests (Liu, Ting and Zhou, 2008), refitted as samples come.

One model serves all symbols. It is first fitted on ``warmup`` samples and again each ``refit`` samples, on the last ``buffer`` ones; a
sample is scored by the model before it joins. Which model scores a sample follows from its index, so every version is fitted
and applied in a group of its own: at most ``buffer`` samples to fit on and ``refit`` to score, all versions in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.fixedpoint import clamp01, idiv
from tidewatch.operators.features import vectorized
from tidewatch.operators.windows import cooldown_by_stretch, numbered
from tidewatch.shipping import ship
from tidewatch.types import FEATURES, SEC

#: When models are fitted and on how much, how alerts are spaced and graded.
WARMUP, REFIT, BUFFER = 150, 100, 1000
TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.04, 42
COOLDOWN = 2 * SEC
URGENT = 0.66


def _depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Random trees as flat arrays over all nodes: feature (-1 in leaves), threshold, children, and the depth that a node stands for.

    All trees grow together, a level at a time. Roots come first.
    """

    def __init__(self, x: np.ndarray, seed: int = SEED, trees: int = TREES, sample: int = SAMPLE, contamination: float = CONTAMINATION) -> None:
        rng = np.random.default_rng(seed)
        self.size, self.roots = min(sample, len(x)), trees
        self._grow(np.concatenate([x[rng.choice(len(x), self.size, replace=False)] for _ in range(trees)]), rng)
        self.offset = float(np.percentile(self.score(x), 100 * contamination))

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> None:
        node = np.repeat(np.arange(self.roots), self.size)
        parts: list[tuple[np.ndarray, ...]] = []
        first, limit = 0, int(np.ceil(np.log2(max(self.size, 2))))
        for d in range(limit + 1):
            order = np.argsort(node, kind="stable")
            x, node = x[order], node[order]
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            count = np.diff(np.append(starts, len(node)))
            lo, hi = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
            able = hi > lo
            splits = able.any(axis=1) & (d < limit)
            feature = np.argmax(rng.random(able.shape) * able, axis=1)
            at = np.arange(len(starts))
            cut = lo[at, feature] + rng.random(len(starts)) * (hi[at, feature] - lo[at, feature])
            cut = np.minimum(cut, np.nextafter(hi[at, feature], lo[at, feature]))  # neither child is empty
            after = first + len(starts)
            left = np.where(splits, after + 2 * (np.cumsum(splits) - 1), -1)
            parts.append((np.where(splits, feature, -1), cut, left, np.where(splits, left + 1, -1), d + _depth(count)))
            own = np.repeat(at, count)
            go = splits[own]
            if not go.any():
                break
            x, own = x[go], own[go]
            node = left[own] + (x[np.arange(len(x)), feature[own]] > cut[own])
            first = after
        self.feature, self.cut, self.left, self.right, self.depth = (np.concatenate(p) for p in zip(*parts, strict=True))

    @classmethod
    def of(cls, size: int, roots: int, offset: float, nodes: dict[str, np.ndarray]) -> Forest:
        """A forest from what was kept of it."""
        forest = cls.__new__(cls)
        forest.size, forest.roots, forest.offset = size, roots, offset
        vars(forest).update(nodes)
        return forest

    def score(self, x: np.ndarray) -> np.ndarray:
        """Near -1 for anomalies, above -0.5 for what is ordinary."""
        at = np.repeat(np.arange(self.roots)[:, None], len(x), axis=1)
        rows = np.arange(len(x))[None, :]
        while (inner := self.feature[at] >= 0).any():
            to = np.where(x[rows, np.maximum(self.feature[at], 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, to, at)
        return -np.power(2.0, -self.depth[at].mean(axis=0) / max(float(_depth(self.size)), 1e-12))

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Below 0 for anomalies."""
        return self.score(x) - self.offset


def _versions(rows: pd.DataFrame) -> pd.DataFrame:
    fit, score = rows[rows["fit"]].sort_values("n"), rows[~rows["fit"]].sort_values("n")
    out = score[["symbol", "seq", "ts_ns", "n", "version"]].copy()
    if len(score) and len(fit):
        out["decision"] = Forest(np.stack(fit["vector"].to_list())).decision(np.stack(score["vector"].to_list()))
    else:
        out["decision"] = pd.Series(np.nan, index=out.index, dtype=float)
    return out


DECISION = "symbol string, seq bigint, ts_ns bigint, n bigint, version bigint, decision double"


def schedule(vectors: DataFrame, warmup: int = WARMUP, refit: int = REFIT, before: int = 0) -> DataFrame:
    """Samples with their index over all symbols, behind ``before`` earlier ones, and the version of the model that scores them, 0 for none."""
    v = numbered(vectors, ["seq"], idiv(F.col("seq"), 100_000)).withColumn("n", F.col("n") + before)
    return v.withColumn("version", F.when(F.col("n") <= warmup, F.lit(0)).otherwise(F.floor((F.col("n") - warmup - 1) / refit) + 1).cast("bigint"))


def learning(samples: DataFrame, above: int, warmup: int, refit: int, buffer: int) -> DataFrame:
    """Samples once for each version over ``above`` that is fitted on them, as ``version``."""
    # Version k is fitted on samples up to warmup + (k - 1) * refit, the last ``buffer`` of them.
    first = F.greatest(F.lit(above + 1), F.ceil((F.col("n") - warmup) / refit).cast("bigint") + 1)
    last = F.floor((F.col("n") + buffer - 1 - warmup) / refit).cast("bigint") + 1
    return samples.withColumn("version", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<bigint>)"))))


def decided(samples: DataFrame, scored: DataFrame, above: int, warmup: int, refit: int, buffer: int) -> DataFrame:
    """The rows ``scored`` with the decisions of their versions, all over ``above``, each fitted on ``samples``."""
    # The newest samples also go to versions that score nothing yet, which are not fitted.
    every = scored.where("version > 0").withColumn("fit", F.lit(False)).unionByName(learning(samples, above, warmup, refit, buffer).withColumn("fit", F.lit(True)))
    return every.groupBy("version").applyInPandas(_versions, DECISION)


def decisions(vectors: DataFrame, warmup: int = WARMUP, refit: int = REFIT, buffer: int = BUFFER) -> DataFrame:
    """Every sample after the warm-up with its decision: symbol, seq, ts_ns, n, version, decision."""
    ship(vectors.sparkSession)
    v = schedule(vectorized(vectors), warmup, refit).select("symbol", "seq", "ts_ns", "n", "version", "vector")
    return decided(v, v, 0, warmup, refit, buffer)


def told(decisions: DataFrame, fired: DataFrame | None = None, before: int = 0) -> DataFrame:
    """Alerts of decisions, numbered behind ``before`` earlier ones; ``fired`` has the time of the last one of each symbol, if there was one."""
    graded = clamp01((0.15 - F.col("decision")) / 0.45)
    d = decisions.where("decision < 0").select("symbol", "seq", "ts_ns", F.round(graded, 4).alias("score"), graded.alias("raw"))
    if fired is not None:  # an earlier alert was kept, and is kept again, before all others
        d = d.unionByName(fired.select("symbol", "ts_ns"), allowMissingColumns=True)
    d = cooldown_by_stretch(d, COOLDOWN, ["ts_ns", "seq"]).where("seq IS NOT NULL")
    d = numbered(d, ["seq"], idiv(F.col("seq"), 100_000)).withColumn("n", F.col("n") + before)
    urgent = F.col("raw") > URGENT
    return d.select(
        F.concat_ws("-", "symbol", F.lit("ml_anomaly"), F.col("n").cast("string")).alias("id"), "n", "seq", "ts_ns", F.lit("ml_anomaly").alias("detector"), "symbol", F.when(urgent, 3).otherwise(2).alias("severity"),
        F.when(urgent, "high").otherwise("medium").alias("severity_label"), "score", F.lit("unusual order flow; advisory, not part of the audit trail").alias("description"),
    )


def alerts(vectors: DataFrame, **schedule_of: int) -> DataFrame:
    """Advisory alerts; they never enter the audit trail."""
    return told(decisions(vectors, **schedule_of))


__all__ = ["FEATURES", "Forest", "alerts", "decided", "decisions", "learning", "schedule", "told"]
