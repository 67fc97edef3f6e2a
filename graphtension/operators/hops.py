"""Bounded breadth-first distances and what is summed over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtension.operators.graph import undirected
from graphtension.session import materialize


def hops(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, id, hop) for all nodes within ``depth`` undirected hops of each source id.

    Each level is a join of the frontier with the adjacency, minus what was seen; levels are written to the shared
    folder so that the plan doesn't grow with the depth.
    """
    adj = materialize(undirected(edges), "adjacency") if depth > 1 else undirected(edges)
    ids = undirected(edges).select(F.col("v").alias("id")).distinct()
    seen = sources.select(F.col("id").alias("source")).distinct().join(ids, F.col("source") == ids.id, "left_semi").select("source", F.col("source").alias("id"), F.lit(0).alias("hop"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(adj, frontier.id == adj.v).select("source", F.col("n").alias("id")).distinct()
        frontier = step.join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("hop", F.lit(d))
        if d < depth:
            frontier = materialize(frontier, "frontier")
        seen = seen.unionByName(frontier)
    return seen


def concealment(edges: DataFrame, tension: DataFrame, sources: DataFrame, lam: float, depth: int) -> DataFrame:
    """(node_id, concealment): tension within ``depth`` hops, discounted by exp(-lam * hop)."""
    h = hops(edges, sources, depth)
    j = h.join(tension.withColumnRenamed("node_id", "id"), "id")
    return j.groupBy(F.col("source").alias("node_id")).agg(F.sum(F.col("tension") * F.exp(-F.lit(float(lam)) * F.col("hop"))).alias("concealment"))


def levels(edges: DataFrame, start: str) -> DataFrame:
    """(id, hop) of everything reachable from one node, until no new node appears.

    A neighbour of a level is in it, the one before or the next, so only two levels are taken from a step.
    """
    adj = materialize(undirected(edges), "adjacency")
    seen = frontier = adj.filter(F.col("v") == start).select(F.col("v").alias("id")).distinct().withColumn("hop", F.lit(0))
    before, d = frontier.limit(0), 0
    while True:
        d += 1
        step = frontier.join(adj, frontier.id == adj.v).select(F.col("n").alias("id")).distinct()
        new = step.join(frontier.unionByName(before).select("id"), "id", "left_anti").withColumn("hop", F.lit(d))
        before, frontier = frontier, materialize(new, "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def fiedler_approx(edges: DataFrame) -> DataFrame:
    """Cheeger-style bound h^2 / (2 d_max) for one cut: the first half of a breadth-first order from the hub.

    Ties go by id, so the value is defined. One cut's h only bounds the best cut from above: a heuristic.
    0 if the graph has fewer than two nodes or isn't connected. The half is found by level counts; only the level
    that the cut goes through is ranked.
    """
    adj = undirected(edges).filter("v <> n")
    ids = undirected(edges).select(F.col("v").alias("id")).distinct()
    deg = ids.join(adj.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("deg")), "id", "left").fillna(0, ["deg"])
    top = deg.orderBy(F.desc("deg"), "id").first()
    spark = edges.sparkSession
    empty = spark.range(1).select(F.lit(0.0).alias("value"))
    if top is None:
        return empty
    n, reach = ids.count(), materialize(levels(edges, top.id), "reach")
    if n < 2 or reach.count() < n:
        return empty
    half, seen, cut = n // 2, 0, []
    for hop, c in sorted((r.hop, r["count"]) for r in reach.groupBy("hop").count().collect()):
        take = min(c, half - seen)
        cut.append((hop, take))
        seen += take
        if seen >= half:
            break
    last, k = cut[-1]
    s = reach.filter(F.col("hop") < last).select("id").unionByName(reach.filter(F.col("hop") == last).orderBy("id").limit(k).select("id"))
    side = deg.join(s.withColumn("s", F.lit(1)), "id", "left").fillna(0, ["s"])
    vol = side.agg(F.sum(F.col("deg") * F.col("s")).alias("a"), F.sum(F.col("deg") * (1 - F.col("s"))).alias("b"), F.max("deg").alias("m"))
    m = side.select(F.col("id").alias("v"), F.col("s").alias("sv"))
    w = side.select(F.col("id").alias("n"), F.col("s").alias("sn"))
    crossing = adj.join(m, "v").join(w, "n").agg(F.coalesce(F.sum(((F.col("sv") == 1) & (F.col("sn") == 0)).cast("bigint")), F.lit(0)).alias("c"))
    small = F.least("a", "b")
    h = F.when(small > 0, F.col("c") / F.nullif(small, F.lit(0))).otherwise(0.0)
    return vol.join(crossing).select(F.coalesce(F.when(F.col("m") > 0, h * h / (2.0 * F.nullif(F.col("m"), F.lit(0)))), F.lit(0.0)).alias("value"))


def velocity(alpha: Column, lam: Column, length: Column) -> Column:
    return F.when((alpha > 0) & (lam > 0) & (length > 0), alpha * F.sqrt(F.greatest(lam, F.lit(0.0))) * length).otherwise(0.0)


def estimate_age(distance: Column, v: Column) -> Column:
    """Seconds since an anomaly began."""
    return F.when((v > 0) & (distance > 0), distance / F.nullif(v, F.lit(0.0))).otherwise(0.0)


def betti(edges: DataFrame) -> DataFrame:
    """beta0 = components, beta1 = E - V + beta0 over undirected edges, by label propagation."""
    adj = materialize(undirected(edges).filter("v <> n"), "adjacency")
    lab = materialize(undirected(edges).select(F.col("v").alias("id")).distinct().withColumn("c", F.col("id")), "labels")
    while True:
        best = adj.join(lab, adj.n == lab.id).groupBy(F.col("v").alias("id")).agg(F.min("c").alias("m"))
        nxt = lab.join(best, "id", "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("d"))
        # a label's own label is at least as small: following it doubles the reach of a round
        up = nxt.select(F.col("id").alias("d"), F.col("d").alias("dd"))
        nxt = materialize(nxt.join(up, "d", "left").select("id", F.col("c").alias("old"), F.least("d", F.coalesce("dd", "d")).alias("c")), "labels")
        changed = nxt.filter("old <> c").limit(1).count()
        lab = nxt.select("id", "c")
        if not changed:
            break
    return lab.agg(F.count_distinct("c").alias("b0"), F.count(F.lit(1)).alias("v")).join(adj.filter("v < n").agg(F.count(F.lit(1)).alias("e"))).select(F.col("b0").alias("beta0"), (F.col("e") - F.col("v") + F.col("b0")).alias("beta1"))


def top_k(df: DataFrame, by: str, k: int, tie: str = "node_id") -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def tail(history: DataFrame, capacity: int) -> DataFrame:
    """Ring buffer: the newest ``capacity`` samples of each node."""
    return history.withColumn("_r", F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("version")))).filter(F.col("_r") <= capacity).drop("_r")
