"""Node tension: how far each neighbour's outgoing distribution moves when the node is taken out.

Zeroing one slot of a distribution and renormalising depends only on that slot's share, so each divergence has a
closed form over one edge. Two shuffles, generated code, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what is added to both sides of a Kullback-Leibler ratio.
EPS = 1e-12


def _log2(c: Column) -> Column:
    return F.log2(F.greatest(c, F.lit(1e-300)))


def jsd(s: Column, k: Column, rest: Column) -> Column:
    keep = F.lit(1.0) - s
    some = 0.5 * (s + F.when(keep > 0, keep * _log2(keep / (1 - s / 2))).otherwise(0.0) - _log2(1 - s / 2))
    k = k.cast("double")
    none = 0.5 * _log2(2 * k / (k + 1)) + 0.5 * (_log2(F.lit(2.0) / (k + 1)) / k + (k - 1) / k)
    return F.when(rest, some).otherwise(none)


def kl(s: Column, k: Column, rest: Column) -> Column:
    keep = F.lit(1.0) - s
    some = (s + EPS) * _log2((s + EPS) / EPS) + F.when(keep > 0, keep * _log2(keep)).otherwise(0.0)
    return F.when(rest, some).otherwise(_log2(k.cast("double")))


def hellinger(s: Column, k: Column, rest: Column) -> Column:
    some = F.sqrt(F.greatest(F.lit(0.0), 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - s))))
    return F.when(rest, some).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - F.sqrt(1 / k.cast("double")))))


def total_variation(s: Column, k: Column, rest: Column) -> Column:
    """Half the summed difference: a user-defined divergence in closed form."""
    return F.when(rest, s).otherwise(1 - 1 / k.cast("double"))


#: name -> (closed form, bounded?)
DIVERGENCES: dict[str, tuple[Callable[[Column, Column, Column], Column], bool]] = {"jsd": (jsd, True), "kl": (kl, False), "hellinger": (hellinger, True), "tv": (total_variation, True)}


def is_bounded(name: str) -> bool:
    return DIVERGENCES[name][1]


def totals(edges: DataFrame) -> DataFrame:
    """Per source: total weight, out-degree, number of positive weights (a count, so that no rounding decides)."""
    return edges.groupBy("src").agg(F.sum("weight").alias("tot"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("weight") > 0).alias("npos"))


def shares(edges: DataFrame) -> DataFrame:
    """Each edge's share of its source's weight; uniform where all weights are 0."""
    e = edges.select("src", "dst", "weight").join(totals(edges), "src")
    return e.withColumn("share", F.when(F.col("tot") > 0, F.col("weight") / F.col("tot")).otherwise(1.0 / F.col("k")))


def tension(edges: DataFrame, divergence: str | Callable[[Column, Column, Column], Column] = "jsd") -> DataFrame:
    """(node_id, tension) of all nodes. Weights must not be negative.

    A neighbour counts in the mean if it has outgoing edges, also when it doesn't point at the node.
    """
    d = DIVERGENCES[divergence][0] if isinstance(divergence, str) else divergence
    e = edges.select("src", "dst", "weight")
    tot = totals(e)
    i = e.join(tot, "src").withColumn("s", F.when(F.col("tot") > 0, F.col("weight") / F.col("tot")).otherwise(0.0))
    i = i.withColumn("rest", F.col("npos") - (F.col("weight") > 0).cast("int") > 0)
    term = F.when((F.col("weight") > 0) & (F.col("tot") > 0), d(F.col("s"), F.col("k"), F.col("rest"))).otherwise(0.0)
    num = i.groupBy(F.col("dst").alias("node_id")).agg(F.sum(term).alias("num"))
    pairs = e.select(F.col("dst").alias("node_id"), F.col("src").alias("n")).union(e.join(tot.select(F.col("src").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node_id"), F.col("dst").alias("n"))).distinct()
    den = pairs.groupBy("node_id").agg(F.count(F.lit(1)).alias("den"))
    ids = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    return ids.join(den, "node_id", "left").join(num, "node_id", "left").select("node_id", F.coalesce(F.greatest(F.col("num"), F.lit(0.0)) / F.col("den"), F.lit(0.0)).alias("tension"))


def smoothed_tension(edges: DataFrame, lam: float, below: int = 10) -> DataFrame:
    """Tension over distributions that lean to the uniform one where a source has fewer than ``below`` edges: the
    observed share counts k / (k + lam)."""
    tot = totals(edges)
    i = edges.select("src", "dst", "weight").join(tot, "src")
    a = F.when(F.col("k") < below, F.col("k") / (F.col("k") + lam)).otherwise(1.0)
    s = a * F.when(F.col("tot") > 0, F.col("weight") / F.col("tot")).otherwise(1 / F.col("k")) + (1 - a) / F.col("k")
    return tension(i.select("src", "dst", s.alias("weight")))


def counterfactual(edges: DataFrame) -> DataFrame:
    """(node_id, tension): how far a node's outgoing shares lie (Jensen-Shannon) from those that its targets' strength
    would give it, were its edges dealt anew with every node's weight kept."""
    into = edges.groupBy("dst").agg(F.sum("weight").alias("pull"))
    e = shares(edges).select("src", "dst", "share").join(into, "dst")
    pulls = e.groupBy("src").agg(F.sum("pull").alias("all"), F.count(F.lit(1)).alias("k"))
    e = e.join(pulls, "src").withColumn("q", F.when(F.col("all") > 0, F.col("pull") / F.col("all")).otherwise(1 / F.col("k")))
    half = lambda c: F.when(F.col(c) > 0, 0.5 * F.col(c) * F.log2(2 * F.col(c) / (F.col("share") + F.col("q")))).otherwise(0.0)
    return e.groupBy(F.col("src").alias("node_id")).agg(F.greatest(F.sum(half("share") + half("q")), F.lit(0.0)).alias("tension"))


#: A piece of a source's targets: at least so many, and as many as keep its element operations near the second figure;
#: shares that are held before pieces go on.
TARGETS, WORK, HELD = 4096, 1 << 28, 1 << 21


def _norm(w: np.ndarray) -> np.ndarray:
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def tension_arrays(edges: DataFrame, compute: Callable) -> DataFrame:
    """The literal definition for a Python ``compute(p, q) -> float`` over whole distributions.

    Only for divergences without a closed form: a source with k targets costs k calls over k shares. Its distribution
    is held once for each piece of its targets, not once for each edge, so k squared is time, never disk.
    """
    dist = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("d")).select("src", F.col("d.dst").alias("names"), F.col("d.weight").alias("w"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for src, names, w in zip(pdf.src, pdf.names, pdf.w, strict=True):
                # the slots of each target: one, unless an edge is given twice
                at = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
                end = np.r_[at[1:], len(names)]
                step = max(TARGETS, WORK // len(names))
                for i in range(0, len(at), step):
                    out.append((src, names[at[i : i + step]], at[i : i + step], end[i : i + step], w))
                    held += len(w)
                    if held > HELD:
                        yield pd.DataFrame(out, columns=["src", "names", "at", "end", "w"])
                        out, held = [], 0
            yield pd.DataFrame(out, columns=["src", "names", "at", "end", "w"])

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for at, end, w in zip(pdf["at"], pdf["end"], pdf.w, strict=True):
                w = np.array(w, dtype=float)
                p = _norm(w)
                for a, b in zip(at, end, strict=True):
                    held = w[a:b].copy()
                    w[a:b] = 0.0
                    out.append(float(compute(p.copy(), _norm(w))))
                    w[a:b] = held
            if out:
                yield pd.DataFrame({"node_id": np.concatenate(list(pdf.names)), "x": out})

    @F.pandas_udf("double")
    def unmoved(weights: pd.Series) -> pd.Series:
        return pd.Series([float(compute(_norm(np.array(w, dtype=float)), _norm(np.array(w, dtype=float)))) for w in weights], dtype=float)

    # by number, since AQE would put pieces of few bytes and much work together
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * edges.sparkSession.sparkContext.defaultParallelism)
    cut = dist.mapInPandas(pieces, "src string, names array<string>, at array<int>, end array<int>, w array<double>").repartition(n, "src", F.col("names")[0])
    cut = cut.mapInPandas(moved, "node_id string, x double")
    # neighbours that don't point back lose nothing: one call for each
    e = edges.select("src", "dst").distinct()
    still = e.select(F.col("src").alias("node_id"), F.col("dst").alias("n")).join(e.select(F.col("dst").alias("node_id"), F.col("src").alias("n")), ["node_id", "n"], "left_anti")
    same = dist.join(still, dist.src == still.n, "left_semi").select(F.col("src").alias("n"), unmoved("w").alias("x"))
    j = cut.unionByName(still.join(same, "n").select("node_id", "x"))
    ids = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    return ids.join(j.groupBy("node_id").agg(F.avg("x").alias("t")), "node_id", "left").select("node_id", F.coalesce("t", F.lit(0.0)).alias("tension"))
