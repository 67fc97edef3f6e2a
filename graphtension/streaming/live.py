"""Live paths: micro-batches into an engine, windowed graphs, and the exact per-event replay as a stateful stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphtension.config import Config
from graphtension.operators.graph import running
from graphtension.plans.engine import Engine
from graphtension.session import discard, materialize


#: Chunks of one micro-batch that a batch's number leaves room for.
MOST_CHUNKS = 1 << 20


def into_engine(stream: DataFrame, engine: Engine, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Append each micro-batch of event rows (the order is that of ``seq``); ``processAllAvailable`` drains.

    A micro-batch goes in as chunks of at most the engine's ``channel_size`` events, so a fast source can't flood a
    version; the source's own limits (``source_limits``) bound what a trigger reads. A chunk that is in the log, of a
    batch that is run again, is passed over: each event counts once. ``name`` tells streams into one engine apart.
    """
    name = name or checkpoint

    def add(df: DataFrame, batch: int) -> None:
        held = materialize(df.coalesce(1) if df.isEmpty() else df, "batch")
        n, size = held.count(), engine.config.channel_size
        if n <= size:
            engine.add_frame(held, name, batch * MOST_CHUNKS)
        else:
            placed = materialize(running(held.withColumn("_key", F.struct(*[c for c in held.columns if not c.startswith("metadata")])), "_key", {"_at": F.lit(1).cast("bigint")}).drop("_key"), "batch")
            for i in range(-(-n // size)):
                engine.add_frame(placed.filter((F.col("_at") >= i * size) & (F.col("_at") < (i + 1) * size)).drop("_at"), name, batch * MOST_CHUNKS + i)
            discard(placed)
        discard(held)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).start()


def source_limits(config: Config, rows_per_file: int = 1000) -> dict[str, str]:
    """Reader options by which sources hand over at most about ``channel_size`` events a trigger."""
    return {"maxOffsetsPerTrigger": str(config.channel_size), "maxFilesPerTrigger": str(max(1, config.channel_size // rows_per_file))}


def edge_stream(stream: DataFrame) -> DataFrame:
    """Running edges; late events are never dropped, as sums, minima and maxima commute."""
    return stream.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("cnt"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def windowed_edges(events: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Edges of each tumbling or sliding window; batch or stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("start"), "src", "dst", "weight", "cnt")


def session_edges(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Edges of each session: an edge's events that follow each other within ``gap``; batch or stream."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("start"), "src", "dst", "weight", "cnt")


class LiveGraph:
    """One graph under events one by one. A node's tension takes one step for each neighbour."""

    def __init__(self) -> None:
        self.out: dict[str, dict[str, float]] = {}
        self.into: dict[str, set[str]] = {}
        self.last: dict[str, float] = {}

    def add(self, src: str, dst: str, weight: float) -> None:
        o = self.out.setdefault(src, {})
        o[dst] = o.get(dst, 0.0) + weight
        self.into.setdefault(dst, set()).add(src)

    def tension(self, v: str) -> float:
        import math

        lg = lambda x: math.log2(x) if x > 0 else 0.0
        near = self.into.get(v, set()) | {n for n in self.out.get(v, {}) if self.out.get(n)}
        total = 0.0
        for n in near:
            dist = self.out.get(n, {})
            w, tot, k = dist.get(v, 0.0), math.fsum(dist.values()), len(dist)
            if w <= 0 or tot <= 0:
                continue
            if any(x > 0 for m, x in dist.items() if m != v):
                s = w / tot
                total += 0.5 * (s + (1 - s) * lg((1 - s) / (1 - s / 2)) - lg(1 - s / 2)) if s < 1 else 0.5 * (s - lg(1 - s / 2))
            else:
                total += 0.5 * lg(2 * k / (k + 1)) + 0.5 * (lg(2 / (k + 1)) / k + (k - 1) / k)
        return max(total, 0.0) / len(near) if near else 0.0

    def step(self, seq: int, src: str, dst: str, weight: float) -> Iterator[tuple]:
        """Source, then target: (seq, node, tension, previous or none)."""
        self.add(src, dst, weight)
        for v in (src, dst):
            t = self.tension(v)
            yield seq, v, t, self.last.get(v)
            self.last[v] = t


REPLAY = "graph_id string, seq bigint, node_id string, tension double, previous double"


def replay(events: DataFrame) -> DataFrame:
    """After every event, both ends' tension; one state per ``graph_id``, so distinct graphs run in parallel.

    One graph's events are in order by nature; micro-batches of the engine are the way for one huge graph.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = LiveGraph()
        rows = [(key[0], *r) for e in pdf.sort_values("seq").itertuples() for r in g.step(e.seq, e.src, e.dst, e.weight)]
        return pd.DataFrame(rows, columns=["graph_id", "seq", "node_id", "tension", "previous"])

    return events.select("graph_id", "seq", "src", "dst", "weight").groupBy("graph_id").applyInPandas(run, REPLAY)


def replay_stream(events: DataFrame) -> DataFrame:
    """The same over a stream; the state is the graph of each id."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        g = pickle.loads(state.get[0]) if state.exists else LiveGraph()
        pdf = pd.concat(list(parts)).sort_values("seq")
        rows = [(key[0], *r) for e in pdf.itertuples() for r in g.step(e.seq, e.src, e.dst, e.weight)]
        state.update((pickle.dumps(g),))
        yield pd.DataFrame(rows, columns=["graph_id", "seq", "node_id", "tension", "previous"])

    return events.groupBy("graph_id").applyInPandasWithState(run, REPLAY, "graph binary", "append", "NoTimeout")


