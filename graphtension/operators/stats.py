"""Aggregates, calibration, detectability and anomaly predicates."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


#: Region aggregators; an empty input gives 0.
AGGREGATIONS = {"mean": lambda c: _or0(F.avg(c)), "max": lambda c: _or0(F.max(c)), "median": lambda c: _or0(F.median(c)), "sum": lambda c: _or0(F.sum(c))}


def result_stats(scored: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Rows (tension, anomaly) to one row; the maximum is floored at 0, the deviation is that of the population.
    ``accuracy``: as in mad_threshold."""
    n, a = F.count(F.lit(1)), F.coalesce(F.sum(F.col("anomaly").cast("bigint")), F.lit(0).cast("bigint"))
    return scored.agg(
        n.alias("nodes_analyzed"), _or0(F.avg("tension")).alias("mean"), _or0(_middle("tension", accuracy)).alias("median"), F.greatest(_or0(F.max("tension")), F.lit(0.0)).alias("max"),
        _or0(F.stddev_pop("tension")).alias("stddev"), a.alias("anomaly_count"), F.when(n > 0, a / n).otherwise(0.0).alias("anomaly_rate"),
    )


def yharim_limit(alpha: float) -> float:
    return math.inf if alpha <= 0 else 0.0 if alpha >= 1 else math.sqrt(2 * math.log(1 / alpha))


def snr(c: str = "tension") -> Column:
    """Mean over population deviation, times the root of n; infinite if nothing varies."""
    n, m, sd = F.count(c), F.avg(c), F.stddev_pop(c)
    return F.when((n == 0) | (m == 0), 0.0).when(sd == 0, float("inf")).otherwise(m / F.nullif(sd, F.lit(0.0)) * F.sqrt(n))


def region_code(ratio: Column, limit: float) -> Column:
    return F.when(ratio > 2 * limit, 2).when(ratio > limit, 1).otherwise(0)


def detectability(scored: DataFrame, alpha: float = 0.05) -> DataFrame:
    limit = yharim_limit(alpha)
    return scored.agg(F.coalesce(snr(), F.lit(0.0)).alias("snr")).select("snr", F.lit(limit).alias("threshold"), region_code(F.col("snr"), limit).alias("region"), F.lit(alpha).alias("alpha"))


def cps(mean: Column, omega: Column, region: Column) -> Column:
    """Concealment pressure: 0 unless detectable and both values are positive."""
    return F.when((region > 0) & (omega > 0) & (mean > 0), 2 / (1 + F.exp(-omega / F.nullif(mean, F.lit(0.0)))) - 1).otherwise(0.0)


def confidence(degree: Column) -> Column:
    return F.when(degree > 0, F.least(F.lit(1.0), degree / 10.0)).otherwise(0.0)


def components(tension: Column, curvature: Column, concealment: Column) -> Column:
    return F.create_map(F.lit("tension"), tension, F.lit("curvature"), curvature, F.lit("concealment"), concealment)


def _middle(c: Column | str, accuracy: int | None) -> Column:
    return F.median(c) if accuracy is None else F.percentile_approx(c, 0.5, accuracy)


def mad_threshold(df: DataFrame, c: str = "tension", k: float = 3.0, accuracy: int | None = None) -> DataFrame:
    """Median, median absolute deviation and threshold, in two passes over the column.

    Exact medians gather a column's distinct values in one task. For columns too large for that, ``accuracy`` takes
    sketches that merge in bounded memory, off by at most 1/accuracy of the rows; a median is then one of the values.
    """
    med = df.agg(_middle(c, accuracy).alias("median"))
    mad = df.select(c).join(F.broadcast(med)).agg(F.first("median").alias("median"), _middle(F.abs(F.col(c) - F.col("median")), accuracy).alias("mad"))
    return mad.select("median", "mad", (F.col("median") + k * F.col("mad")).alias("threshold"))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in an order: a top-k plan, not a sort of everything."""
    return df.orderBy(order).limit(n)


@dataclass
class MadCalibrator:
    """Learns a threshold from the first ``warmup`` observations; later ones count only after recalibrate().

    Not warm: nothing is an anomaly. A given median and deviation make it warm at once. Until it is warm it holds the
    observations, at most ``warmup`` of them, over any number of batches.
    """

    k: float = 3.0
    warmup: int = 1000
    median: float | None = None
    mad: float | None = None
    observed: int = 0
    held: list[float] = field(default_factory=list)

    @property
    def warm(self) -> bool:
        return self.median is not None

    @property
    def threshold(self) -> float:
        return self.median + self.k * self.mad if self.warm else 0.0

    def fit(self, df: DataFrame, c: str = "tension", order: str | None = None) -> MadCalibrator:
        """Observe a column, in ``order``, or in that of the values. Freezes at the first warm-up."""
        self.observed += df.count()
        if not self.warm:
            self.held += [r[c] for r in first_rows(df.select(*{c, order or c}), order or c, self.warmup - len(self.held)).collect()]
            if len(self.held) >= self.warmup:
                x = np.array(self.held)
                self.median = float(np.median(x))
                self.mad, self.held = float(np.median(np.abs(x - self.median))), []
        return self

    def recalibrate(self, df: DataFrame, c: str = "tension") -> MadCalibrator:
        row = mad_threshold(df, c, self.k).first()
        self.median, self.mad = row["median"], row["mad"]
        return self

    def predicate(self, c: Column) -> Column:
        return c > self.threshold if self.warm else F.lit(False)

    def stats(self) -> dict:
        return {"observed": self.observed, "warm": self.warm, "median": self.median, "mad": self.mad, "threshold": self.threshold, "k": self.k}

    def state(self) -> dict:
        """What a reopened engine needs."""
        return {"median": self.median, "mad": self.mad, "observed": self.observed, "held": self.held}

    def restore(self, state: dict) -> None:
        self.median, self.mad, self.observed, self.held = (state[c] for c in ("median", "mad", "observed", "held"))


def is_anomaly(tension: Column, node: Column, threshold: float = 0.2, calibrator: MadCalibrator | None = None, threshold_func=None) -> Column:
    """A threshold function rules; else a warm calibrator; else the static threshold, strictly."""
    if threshold_func is not None:
        return threshold_func(node, tension)
    return calibrator.predicate(tension) if calibrator is not None and calibrator.warm else tension > threshold


def triage(df: DataFrame, weights: dict[str, float], cut: float) -> DataFrame:
    """Weighted sum of columns scaled to 0..1 by their range; rows at or above ``cut``."""
    lows = df.agg(*[F.min(c).alias(f"lo_{c}") for c in weights], *[F.max(c).alias(f"hi_{c}") for c in weights])
    scaled = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0))).otherwise(0.0)
    score = reduce(lambda a, b: a + b, [w * scaled(c) for c, w in weights.items()])
    return df.join(F.broadcast(lows)).withColumn("score", score).filter(F.col("score") >= cut)


def sniper_gap(df: DataFrame) -> DataFrame:
    """How far a node's tension lies from the mean of nodes with its degree, in deviations.

    Degrees are summed up first, one row each, so a degree that most nodes have is no group of its own.
    """
    by = df.groupBy("degree").agg(F.avg("tension").alias("_m"), F.stddev_pop("tension").alias("_s"))
    return df.join(by, "degree").withColumn("gap", F.when(F.col("_s") > 0, (F.col("tension") - F.col("_m")) / F.nullif("_s", F.lit(0.0))).otherwise(0.0)).drop("_m", "_s")


def low_degree(df: DataFrame, least: int, mode: str = "flag") -> DataFrame:
    """Rows (degree, anomaly, ...) of nodes with fewer than ``least`` edges: left out (``filter``), or marked in
    ``insufficient``, never an anomaly (``flag``)."""
    few = F.col("degree") < least
    return df.filter(~few) if mode == "filter" else df.withColumn("insufficient", few).withColumn("anomaly", F.col("anomaly") & ~few)
