"""Samples over time: history, trends, indicators, phases and the change feed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtension.schema import DELTA_TYPES, DELTAS
from graphtension.session import materialize

#: A trend needs this change, a phase turns at these levels.
TREND_STEP, RHO_CRITICAL, PI_CRITICAL, RHO_CAP, FLAT_DECAY = 0.01, 1.0, 0.5, 2.0, 0.01

def _by_node():
    return Window.partitionBy("node_id").orderBy("version")



def with_previous(history: DataFrame) -> DataFrame:
    return history.withColumn("previous", F.lag("tension").over(_by_node()))


def latest(history: DataFrame) -> DataFrame:
    return history.groupBy("node_id").agg(F.max("version").alias("version"), F.max_by("tension", "version").alias("tension"))


def series(history: DataFrame) -> DataFrame:
    """Samples oldest first, as one array for each node; feed it a capped history."""
    return history.groupBy("node_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("version", "tension"))), lambda x: x.tension).alias("tensions"))


def trend(now: Column, before: Column) -> Column:
    d = now - before
    return F.when(d > TREND_STEP, 1).when(d < -TREND_STEP, 2).otherwise(0)


def trend_changes(history: DataFrame) -> DataFrame:
    """Samples whose trend differs from that of the sample before; a node's first sample is stable."""
    h = with_previous(history).withColumn("trend", F.coalesce(trend(F.col("tension"), F.col("previous")), F.lit(0)))
    return h.withColumn("last_trend", F.lag("trend").over(_by_node())).filter("last_trend is not null and trend <> last_trend")


def spikes(history: DataFrame, threshold: float = 0.3) -> DataFrame:
    return with_previous(history).withColumn("delta", F.abs(F.col("tension") - F.col("previous"))).filter(F.col("delta") > threshold)


def shock(now: DataFrame, before: DataFrame, key: list[str], c: str) -> DataFrame:
    """Largest absolute change over the union of keys, a missing value being 0."""
    j = now.select(*key, F.col(c).alias("_n")).join(before.select(*key, F.col(c).alias("_b")), key, "full_outer")
    return j.agg(F.coalesce(F.max(F.abs(F.coalesce("_n", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))), F.lit(0.0)).alias("shock"))


def indicators(now: DataFrame, before: DataFrame, dt: float, curv_now: DataFrame | None = None, curv_before: DataFrame | None = None) -> DataFrame:
    """Spike, decay exponent and curvature shock between two tension frames ``dt`` seconds apart."""
    spike = shock(now, before, ["node_id"], "tension").withColumnRenamed("shock", "tension_spike")
    c, p = now.agg(F.avg("tension").alias("c")), before.agg(F.avg("tension").alias("p"))
    ok = (F.col("c") > 0) & (F.col("p") > 0) & F.lit(dt > 0)
    decay = F.when(ok, -(F.ln(F.col("c")) - F.ln(F.col("p"))) / (dt or 1.0)).otherwise(0.0)
    out = spike.join(c).join(p).withColumn("decay_exponent", decay)
    if curv_now is not None and curv_before is not None:
        out = out.join(shock(curv_now, curv_before, ["src", "dst"], "curvature").withColumnRenamed("shock", "curvature_shock"))
    else:
        out = out.withColumn("curvature_shock", F.lit(0.0))
    return out.select("tension_spike", "decay_exponent", "curvature_shock", F.coalesce("c", F.lit(0.0)).alias("mean"), F.coalesce("p", F.lit(0.0)).alias("previous_mean"))


def rho(spike: Column, decay: Column, mean: Column) -> Column:
    base = F.when(decay < 0, F.abs(decay)).when((decay < FLAT_DECAY) & (mean > 0), mean).otherwise(0.0)
    return F.least(base + spike, F.lit(RHO_CAP))


def pi(connectivity: Column) -> Column:
    return F.greatest(F.least(connectivity, F.lit(1.0)), F.lit(0.0))


def phase(r: Column, p: Column) -> Column:
    return F.when(r < RHO_CRITICAL, F.when(p >= PI_CRITICAL, 0).otherwise(1)).otherwise(F.when(p >= PI_CRITICAL, 2).otherwise(3))


def connectivity(now: DataFrame, before: DataFrame) -> DataFrame:
    """The part of the nodes before that is still there."""
    j = before.select("node_id").join(now.select("node_id", F.lit(1).alias("_h")), "node_id", "left")
    return j.agg(F.coalesce(F.avg(F.coalesce("_h", F.lit(0)).cast("double")), F.lit(0.0)).alias("ratio"))


def edge_deltas(events: DataFrame, epoch: int | None = None, overlay: DataFrame | None = None) -> DataFrame:
    """One change row per event: added at the first event of an edge (again after a compaction, if every ``epoch``
    events one is made), else updated; with the edge's weight before and after. Edges that ``overlay`` (src, dst,
    weight), the graph before these events, has are updated from there."""
    e = events.withColumn("_e", F.floor((F.col("seq") - 1) / epoch) if epoch else F.lit(0))
    if overlay is not None:
        e = e.join(overlay.select("src", "dst", F.col("weight").alias("_held")), ["src", "dst"], "left")
    else:
        e = e.withColumn("_held", F.lit(None).cast("double"))
    w = Window.partitionBy("_e", "src", "dst").orderBy("seq")
    before = F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.coalesce("_held", F.lit(0.0))
    first = (F.row_number().over(w) == 1) & F.col("_held").isNull()
    kind = F.when(first, DELTA_TYPES["edge_added"]).otherwise(DELTA_TYPES["edge_updated"])
    return e.select("seq", "src", "dst", kind.alias("delta_type"), before.alias("previous"), (before + F.col("weight")).alias("current"))


def node_deltas(events: DataFrame, epoch: int | None = None, overlay: DataFrame | None = None) -> DataFrame:
    """Node-added rows at a node's first event, unless ``overlay`` has it. Both ends are looked up before the event,
    so a new node with a self-loop is told twice."""
    e = events.withColumn("_e", F.floor((F.col("seq") - 1) / epoch) if epoch else F.lit(0))
    ends = e.select("_e", "seq", F.explode(F.array("src", "dst")).alias("node_id"))
    first = ends.groupBy("_e", "node_id").agg(F.min("seq").alias("first"))
    if overlay is not None:
        first = first.join(overlay.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), "node_id", "left_anti")
    return ends.join(first, ["_e", "node_id"]).filter("seq = first").select("seq", "node_id", F.lit(DELTA_TYPES["node_added"]).alias("delta_type"))


def _feed(df: DataFrame, **cols: Column) -> DataFrame:
    kinds = dict(x.split(" ") for x in DELTAS.split(", "))
    return df.select(*[cols.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def change_feed(events: DataFrame, overlay: DataFrame) -> DataFrame:
    """Changes that events make to the graph before them, as rows of one schema; a row's version is its event's."""
    n = node_deltas(events, overlay=overlay)
    e = edge_deltas(events, overlay=overlay)
    nodes = _feed(n, type=F.col("delta_type"), version=F.col("seq"), node_id=F.col("node_id"))
    return nodes.unionByName(_feed(e, type=F.col("delta_type"), version=F.col("seq"), edge_from=F.col("src"), edge_to=F.col("dst"), previous=F.col("previous"), weight=F.col("current")))


def tension_feed(samples: DataFrame, kind: str) -> DataFrame:
    """Samples (node_id, version, tension) as changes of one kind."""
    return _feed(samples, type=F.lit(DELTA_TYPES[kind]), version=F.col("version"), node_id=F.col("node_id"), tension=F.col("tension"))


def compaction_epochs(events: DataFrame, threshold: int) -> DataFrame:
    """Which compaction, by volume, each event falls into, and how many events it folds."""
    return events.groupBy(F.floor((F.col("seq") - 1) / threshold).cast("bigint").alias("epoch")).agg(F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def before_after(events: DataFrame, marks: DataFrame, seconds: int) -> DataFrame:
    """Mean weight of each user's events within ``seconds`` before and after each mark (id, src, ts).

    The range join is an equi-join on the key and on slots of ``seconds``: each event meets its own slot and its two
    neighbours only.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    e = events.select("src", F.col("ts").alias("_t"), "weight", F.explode(F.array(*[slot("ts") + d for d in (-1, 0, 1)])).alias("_s"))
    j = marks.withColumn("_s", slot("ts")).join(e, ["src", "_s"], "left")
    gap = (F.unix_micros("_t") - F.unix_micros("ts")) / 1e6
    pre, post = (gap < 0) & (gap >= -seconds), (gap > 0) & (gap <= seconds)
    return j.groupBy("id").agg(F.avg(F.when(pre, F.col("weight"))).alias("pre"), F.avg(F.when(post, F.col("weight"))).alias("post"))


#: Events of one source that are folded at once.
CHUNK = 4096


def relative_weight(events: DataFrame, span: int = 365) -> DataFrame:
    """Each event's weight over the exponential mean of its source's events so far (itself included).

    A source's events are folded in chunks: what a chunk adds, then what goes from chunk to chunk, then the events of
    each chunk with what came before. So no group holds more than CHUNK events, or one row for each chunk.
    """
    a = 2.0 / (span + 1)
    pos = F.row_number().over(Window.partitionBy("src").orderBy("seq")) - 1
    e = materialize(events.select("src", "seq", "weight").withColumn("_i", pos).withColumn("chunk", F.floor(F.col("_i") / CHUNK).cast("bigint")), "chunks")

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_i")
        w = rows["weight"].to_numpy()
        carry = rows["carry"][0].as_py()
        out, ema = np.empty(len(w)), carry
        for i, x in enumerate(w.tolist()):
            ema = x if ema is None else a * x + (1 - a) * ema
            out[i] = ema
        return pa.table({"src": rows["src"], "seq": rows["seq"], "chunk": rows["chunk"], "weight": rows["weight"], "ema": pa.array(out)})

    kind = "src string, seq bigint, chunk bigint, weight double, ema double"
    # from chunk to chunk: an empty start adds its share, which the number of events tells
    ends = e.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("_i", "weight"))).alias("ws"))
    step = lambda s, x: F.when(s.isNull(), x.weight).otherwise(a * x.weight + (1 - a) * s)
    first = F.aggregate("ws", F.lit(None).cast("double"), step)
    rest = F.aggregate("ws", F.lit(0.0), lambda s, x: a * x.weight + (1 - a) * s)
    ends = ends.select("src", "chunk", F.when(F.col("chunk") == 0, first).otherwise(rest).alias("x"), F.pow(F.lit(1 - a), F.col("n")).alias("keep"))
    by_src = ends.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("chunk", "x", "keep"))).alias("c"))
    zero = F.struct(F.lit(0.0).alias("ema"), F.array().cast("array<double>").alias("out"))
    run = F.aggregate("c", zero, lambda s, x: F.struct((x.x + F.when(x.chunk == 0, 0.0).otherwise(x.keep) * s.ema).alias("ema"), F.concat(s.out, F.array(x.x + F.when(x.chunk == 0, 0.0).otherwise(x.keep) * s.ema)).alias("out")))["out"]
    carry = by_src.select("src", F.posexplode(run).alias("at", "carry")).select("src", (F.col("at") + 1).cast("bigint").alias("chunk"), "carry")
    folded = e.join(carry, ["src", "chunk"], "left").groupBy("src", "chunk").applyInArrow(fold, kind)
    return folded.select("src", "seq", F.when(F.col("ema") > 0, F.col("weight") / F.nullif(F.col("ema"), F.lit(0.0))).otherwise(0.0).alias("relative"))
