"""The engine: an append-only event log, versions, snapshots, compaction, and what is kept between them.

A version is a position in the log; a snapshot is a version together with the base that belongs to it, so readers
never pair a new base with an old overlay. Events, bases and histories are Parquet under one shared path. After each
change a small control file names all that is in force: an engine opened on the same path goes on from there, and
what a lost writer left half-done isn't named and goes with the next collection.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from graphtension import schema
from graphtension.config import Config
from graphtension.errors import EngineRunning, EngineStopped, NodeNotFound, SnapshotClosed
from graphtension.operators import graph, hops, stats, temporal
from graphtension.plans import analyze, export
from graphtension.plans.cache import ResultCache
from graphtension.session import names_in, read_text, remove, write_text
from graphtension.sources import events as source

#: Control files that stay, and history folders that are read before they are written anew as one.
CONTROLS, HISTORIES = 5, 16


@dataclass(frozen=True)
class Version:
    """What a reader sees: a base folder (or none) and the batches of events since."""

    number: int = 0
    base: str | None = None
    batches: tuple[str, ...] = ()
    overlay_events: int = 0
    ts: float = 0.0


@dataclass
class Snapshot:
    """An isolated view of one version. close() is idempotent; anything else fails after it."""

    engine: Engine
    version: Version
    opened: float = field(default_factory=time.monotonic)
    closed: bool = False
    _edges: DataFrame | None = None

    @property
    def id(self) -> str:
        self._open()
        return f"snap-{self.version.number}"

    def _open(self) -> None:
        if self.closed:
            raise SnapshotClosed(f"snap-{self.version.number}")

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.engine._released(self)
            if self._edges is not None:
                self._edges.unpersist()

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def timestamp(self) -> float:
        self._open()
        return self.version.ts

    @property
    def overlay(self) -> DataFrame:
        self._open()
        return self.engine._overlay(self.version)

    @property
    def edges(self) -> DataFrame:
        """Base and overlay as one; kept in memory (and spilled) while the snapshot is open."""
        self._open()
        if self._edges is None:
            base = self.engine._base(self.version)
            self._edges = (graph.merge_edges(base, self.overlay) if base is not None else self.overlay).persist()
        return self._edges

    @property
    def nodes(self) -> DataFrame:
        """Degrees from the edges; attributes, and types where none is derived, from the base, whose nodes without
        edges are nodes too."""
        f = self.engine.config.node_type_func
        return graph.with_stored(graph.nodes_of(self.edges, f(F.col("id")) if f else None), self.engine._base_nodes(self.version))

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def get_node(self, node: str) -> Row | None:
        return self.nodes.filter(F.col("id") == node).first()

    def get_edge(self, src: str, dst: str) -> Row | None:
        return self.edges.filter((F.col("src") == src) & (F.col("dst") == dst)).first()

    def neighbors(self, node: str) -> DataFrame:
        return graph.undirected(self.edges).filter(F.col("v") == node).select(F.col("n").alias("id"))

    def in_neighbors(self, node: str) -> DataFrame:
        return graph.in_neighbors(self.edges, node)

    def out_neighbors(self, node: str) -> DataFrame:
        return graph.out_neighbors(self.edges, node)

    def for_each_node(self) -> Iterator[Row]:
        return self.nodes.toLocalIterator()

    def for_each_edge(self) -> Iterator[Row]:
        return self.edges.toLocalIterator()

    def export(self, path: str, fmt: str = "json") -> None:
        export.export(self.nodes, self.edges, path, fmt)

    def _cached(self, kind: str, args: str, make):
        self._open()
        cache = self.engine.cache
        if cache is None:
            return make()
        key = (self.version.number, kind, args)
        found = cache.get(key)
        return found if found is not None else cache.put(key, make())

    def analyze(self, dt: float = 0.0) -> analyze.Results:
        """All nodes; with at least two samples of history, trends and the temporal block against the sample before
        the newest."""
        before = self.engine.previous_tensions()
        make = lambda: analyze.analyze(self.edges, self.engine.config, before, dt)
        if self.engine.cache is None:
            self._open()
            return make()
        return self._cached("analyze", f"{dt}", lambda: make().settled())

    def analyze_node(self, node: str) -> Row:
        row = self._cached("node", node, lambda: analyze.analyze_node(self.edges, node, self.engine.config).first())
        if row is None:
            raise NodeNotFound(node)
        return row

    def analyze_region(self, ids: list[str]) -> Row:
        return self._cached("region", ",".join(sorted(ids)), lambda: analyze.analyze_region(self.edges, ids, self.engine.config).first())

    def get_tension(self, node: str) -> float:
        return self.analyze_node(node).tension

    def get_curvature(self, src: str, dst: str) -> float:
        """0 for an edge that isn't there."""
        alpha = self.engine.config.curvature_alpha or 0.5
        row = analyze.curvature_of(self.edges, self.engine.config.curvature_func, alpha).filter((F.col("src") == src) & (F.col("dst") == dst)).first()
        return row.curvature if row else 0.0


class Engine:
    """Single writer over a shared path. ``add_events`` starts a stopped engine again.

    An engine on a path that one has written before goes on from its last control file; else it begins with what the
    storage holds, or with the given base graph (edges, or a GraphData with nodes).
    """

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self.log = self.config.logger or logging.getLogger("graphtension")
        self.cache = ResultCache(self.config.cache_ttl_s) if self.config.cache_ttl_s else None
        self.version, self.running, self.events_total = Version(), False, 0
        self.snapshots: dict[int, list[Snapshot]] = {}
        self.history: list[str] = []
        #: Base and log folders that may still be read, with the version that made each.
        self.folders: list[tuple[int, str]] = []
        #: For each stream the last batch that is in the log.
        self.streams: dict[str, int] = {}
        self.lock, self._wake = threading.RLock(), threading.Event()
        self.began = self.last_compaction = time.monotonic()
        self.controls = 0
        if not self._reopen():
            base = self.config.base_graph
            if self.config.storage is not None:
                try:
                    base = self.config.storage.load(spark) or base
                except Exception as e:  # a store that can't be read leaves the engine with the given base
                    self._report(e)
            if base is not None:
                self._new_base(graph.as_data(base))

    # what survives

    def _reopen(self) -> bool:
        names = [n for n in names_in(self.spark, f"{self.path}/control") if n.endswith(".json")]
        if not names:
            return False
        held = json.loads(read_text(self.spark, f"{self.path}/control/{names[-1]}"))
        self.controls = int(names[-1].split(".")[0]) + 1
        self.version = Version(**held["version"] | {"batches": tuple(held["version"]["batches"])})
        self.events_total, self.history, self.streams = held["events_total"], held["history"], held["streams"]
        self.folders = [tuple(x) for x in held["folders"]]
        if self.config.calibrator is not None and held["calibrator"] is not None:
            self.config.calibrator.restore(held["calibrator"])
        return True

    def _commit(self) -> None:
        c = self.config.calibrator
        state = c.state() if c is not None and hasattr(c, "state") else None
        held = {"version": asdict(self.version), "events_total": self.events_total, "history": self.history, "streams": self.streams, "folders": self.folders, "calibrator": state}
        write_text(self.spark, f"{self.path}/control/{self.controls:012}.json", json.dumps(held))
        if self.controls >= CONTROLS:
            remove(self.spark, f"{self.path}/control/{self.controls - CONTROLS:012}.json")
        self.controls += 1

    # lifecycle

    def start(self) -> None:
        """Runs until stop(); meanwhile old cache entries and folders are looked after every so many seconds."""
        if self.running:
            raise EngineRunning
        self.running, self.began, self._wake = True, time.monotonic(), threading.Event()
        if self.config.upkeep_s > 0:
            threading.Thread(target=self._upkeep, args=(self._wake,), daemon=True).start()

    def _upkeep(self, wake: threading.Event) -> None:
        while not wake.wait(self.config.upkeep_s):
            try:
                if self.cache is not None:
                    self.cache.evict()
                self.gc()
            except Exception as e:
                self._report(e)

    def stop(self) -> None:
        if not self.running:
            raise EngineStopped
        self.running = False
        self._wake.set()

    def _callback(self, name: str, *args) -> None:
        """A callback's failure is reported, never raised."""
        f = self.config.callbacks.get(name)
        if f is not None:
            try:
                f(*args)
            except Exception as e:
                self._report(e)

    def _report(self, e: Exception) -> None:
        self.log.error("%s", e)
        f = self.config.callbacks.get("on_error")
        if f is not None:
            f(e)

    # writing

    def add_event(self, src: str, dst: str, type: str = "", weight: float = 0.0, ts=None, metadata: dict | None = None) -> None:
        self.add_events([(src, dst, type, weight, ts, metadata)])

    def add_events(self, rows: Iterable[tuple]) -> None:
        rows = [(i, *r, *[None] * (6 - len(r))) for i, r in enumerate(rows)]
        self.add_frame(self.spark.createDataFrame(rows, schema.EVENTS))

    def add_frame(self, df: DataFrame, stream: str | None = None, batch: int = 0) -> bool:
        """Validate all, then append all, in the order of ``seq``; nothing is kept if one event is invalid.

        A ``batch`` of a ``stream`` that is in the log already is passed over: False.
        """
        with self.lock:
            if stream is not None and batch <= self.streams.get(stream, -1):
                return False
            source.checked_batch(df)
            if not self.running:
                self.start()
            df = source.project(source.normalize(df, default=self.config.default_weight), self.config.weight_func)
            df = graph.running(df, "seq", {"_pos": F.lit(1).cast("bigint")}).drop("seq")
            before = self.version
            at = before.number
            df = df.select((F.col("_pos") + at + 1).alias("seq"), "src", "dst", "type", "weight", "ts", "metadata")
            folder = f"{self.path}/log/{uuid.uuid4().hex}"
            df.write.parquet(folder)
            held = self.spark.read.schema(schema.EVENTS).parquet(folder)
            n, ts = held.agg(F.count(F.lit(1)), F.unix_micros(F.max_by("ts", "seq"))).first()
            if stream is not None:
                self.streams[stream] = batch
            if not n:
                remove(self.spark, folder)
                self._commit()
                return True
            overlay = self._overlay(before)
            self.version = replace(before, number=at + n, batches=(*before.batches, folder), overlay_events=before.overlay_events + n, ts=(ts or 0) / 1e6)
            self.folders.append((self.version.number, folder))
            self.events_total += n
            if self.cache is not None:
                self.cache.invalidate(before.number)
            if "on_change" in self.config.callbacks:
                self._callback("on_change", temporal.change_feed(held, overlay))
            self._check(held)
            self._commit()
            if self._due():
                self.compact()
            return True

    def _check(self, held: DataFrame) -> None:
        """After a batch: tensions of the touched nodes, to the history; spikes, anomalies and changes of trend to the
        callbacks."""
        told = self.config.callbacks
        if not ({"on_anomaly", "on_tension_spike"} & set(told)):
            return
        v = self.version
        view = self._overlay(v) if self.config.realtime_scope == "overlay" else self.edges_at(v)
        ids = held.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        t = analyze.tension_of(analyze.near(view, ids), self.config.divergence).join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
        path = f"{self.path}/history/{uuid.uuid4().hex}"
        t.select("node_id", F.lit(v.number).cast("bigint").alias("version"), F.timestamp_micros(F.lit(int(v.ts * 1e6))).alias("ts"), "tension").write.parquet(path)
        self.history.append(path)
        now = self.spark.read.schema(schema.HISTORY).parquet(path)
        if self.config.calibrator is not None:
            self.config.calibrator.fit(now, order="node_id")
        touched = self.tension_history().join(now.select("node_id"), "node_id", "left_semi")
        if "on_tension_spike" in told and len(self.history) > 1:
            spiked = temporal.spikes(touched, self.config.tension_spike_threshold).filter(F.col("version") == v.number)
            if not spiked.isEmpty():
                self._callback("on_tension_spike", spiked)
        flag = stats.is_anomaly(F.col("tension"), F.col("node_id"), self.config.threshold, self.config.calibrator, self.config.threshold_func)
        odd = now.filter(flag)
        if "on_anomaly" in told and not odd.isEmpty():
            self._callback("on_anomaly", odd)
        if "on_change" in told:
            turned = temporal.trend_changes(touched).filter(F.col("version") == v.number)
            feed = temporal.tension_feed(turned, "tension_changed").unionByName(temporal.tension_feed(odd, "anomaly_detected"))
            if not feed.isEmpty():
                self._callback("on_change", feed)
        if len(self.history) > HISTORIES:
            self._fold_history()

    def _fold_history(self) -> None:
        """The newest samples of each node as one folder; the others go once no control file names them."""
        path = f"{self.path}/history/{uuid.uuid4().hex}"
        self.tension_history().select("node_id", "version", "ts", "tension").write.parquet(path)
        self.folders += [(self.version.number, p) for p in self.history]
        self.history = [path]

    def tension_history(self) -> DataFrame:
        """The newest samples of each node, as many as the capacity."""
        if not self.history:
            return self.spark.createDataFrame([], schema.HISTORY)
        return hops.tail(self.spark.read.schema(schema.HISTORY).parquet(*self.history), self.config.temporal_capacity)

    def previous_tensions(self) -> DataFrame | None:
        """Each node's second-newest sample; none before there is one."""
        if not self.history:
            return None
        r = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("version")))
        out = self.tension_history().withColumn("_r", r).filter("_r = 2").select("node_id", "tension")
        return None if out.isEmpty() else out

    # reading

    def _overlay(self, v: Version) -> DataFrame:
        ev = self.spark.read.schema(schema.EVENTS).parquet(*v.batches) if v.batches else self.spark.createDataFrame([], schema.EVENTS)
        return graph.edges_of(ev)

    def _base(self, v: Version) -> DataFrame | None:
        return self.spark.read.schema(schema.EDGES).parquet(f"{v.base}/edges") if v.base else None

    def _base_nodes(self, v: Version) -> DataFrame | None:
        return self.spark.read.schema(schema.STORED_NODES).parquet(f"{v.base}/nodes") if v.base else None

    def edges_at(self, v: Version) -> DataFrame:
        base = self._base(v)
        return graph.merge_edges(base, self._overlay(v)) if base is not None else self._overlay(v)

    def snapshot(self) -> Snapshot:
        with self.lock:
            s = Snapshot(self, self.version)
            self.snapshots.setdefault(self.version.number, []).append(s)
            return s

    def _released(self, s: Snapshot) -> None:
        with self.lock:
            held = self.snapshots.get(s.version.number, [])
            if s in held:
                held.remove(s)
            if not held:
                self.snapshots.pop(s.version.number, None)

    def analyze(self, dt: float = 0.0) -> analyze.Results:
        """Of the newest version, computed before its snapshot closes."""
        with self.snapshot() as s:
            return s.analyze(dt).settled()

    def analyze_node(self, node: str) -> Row:
        with self.snapshot() as s:
            return s.analyze_node(node)

    def analyze_region(self, ids: list[str]) -> Row:
        with self.snapshot() as s:
            return s.analyze_region(ids)

    def stats(self) -> dict:
        """Layer counts; ``nodes`` and ``edges`` add both layers as told, the distinct ones stand beside."""
        v = self.version
        over, both = graph.counts(self._overlay(v)).first(), graph.counts(self.edges_at(v)).first()
        base, kept = self._base(v), self._base_nodes(v)
        base_nodes, base_edges = (kept.count(), base.count()) if base is not None else (0, 0)
        alone = graph.isolated(self.edges_at(v), kept).count() if kept is not None else 0
        up = max(time.monotonic() - self.began, 1e-9)
        return {
            "nodes": over.nodes + base_nodes, "edges": over.edges + base_edges, "distinct_nodes": both.nodes + alone, "distinct_edges": both.edges,
            "overlay_events": v.overlay_events, "base_nodes": base_nodes, "base_edges": base_edges, "versions_current": v.number, "versions_total": v.number,
            "snapshots_active": sum(map(len, self.snapshots.values())), "events_total": self.events_total, "events_per_second": self.events_total / up, "uptime_s": up,
        }

    # upkeep

    def _due(self) -> bool:
        c = self.config
        return (c.compaction_strategy == "volume" and self.version.overlay_events >= c.compaction_threshold) or (c.compaction_strategy == "time" and time.monotonic() - self.last_compaction >= c.compaction_interval_s)

    def _new_base(self, data: graph.GraphData) -> None:
        path = f"{self.path}/base/{uuid.uuid4().hex}"
        data.edges.write.parquet(f"{path}/edges")
        graph.stored_nodes(self.spark.read.schema(schema.EDGES).parquet(f"{path}/edges"), data.nodes).write.parquet(f"{path}/nodes")
        self.version = replace(self.version, number=self.version.number + 1, base=path, batches=(), overlay_events=0)
        self.folders.append((self.version.number, path))
        self._commit()

    def compact(self) -> dict:
        """Fold the overlay into a new base; the base's edge type wins. Then the store is told."""
        with self.lock:
            began, v = time.monotonic(), self.version
            base, over = self._base(v), self._overlay(v)
            if base is None:
                n = graph.counts(over).first()
                told = {"nodes_merged": 0, "edges_merged": 0, "overlay_before": n.nodes + n.edges, "overlay_after": 0}
                merged = over
            else:
                told = graph.compact_stats(graph.nodes_of(base), base, graph.nodes_of(over), over).first().asDict()
                merged = graph.merge_edges(base, over, "base")
            kept = self._base_nodes(v)
            f = self.config.node_type_func
            if f is not None:
                kept = graph.stored_nodes(merged, kept).withColumn("type", F.when(F.coalesce("type", F.lit("")) == "", f(F.col("id"))).otherwise(F.col("type")))
            self._new_base(graph.GraphData(merged, kept))
            told["duration_s"], told["timestamp"], self.last_compaction = time.monotonic() - began, time.time(), time.monotonic()
            if self.config.storage is not None:
                try:
                    self.config.storage.save(graph.GraphData(self._base(self.version), self._base_nodes(self.version), {"version": str(self.version.number)}))
                except Exception as e:
                    self._report(e)
        self._callback("on_compact", told)
        return told

    def reset(self) -> None:
        """An empty graph under a new version; history, cache and the event counter stay."""
        with self.lock:
            self.version = Version(self.version.number + 1, ts=time.time())
            self._commit()

    def gc(self, now: float | None = None) -> dict:
        """Warn about old snapshots, close very old ones, and delete bases, batches and histories that no version in
        use needs, and folders that no control file names."""
        with self.lock:
            now = time.monotonic() if now is None else now
            for s in [s for held in self.snapshots.values() for s in held]:
                if self.config.gc_snapshot_force_s and now - s.opened > self.config.gc_snapshot_force_s:
                    s.close()
                elif self.config.gc_snapshot_warning_s and now - s.opened > self.config.gc_snapshot_warning_s and not getattr(s, "warned", False):
                    s.warned = True
                    self.log.warning("snapshot %s is open for %.0f s", s.version.number, now - s.opened)
            views = [self.version, *(s.version for held in self.snapshots.values() for s in held)]
            used = {p for v in views for p in (v.base, *v.batches)} | set(self.history)
            gone = [(n, p) for n, p in self.folders if p not in used]
            self.folders = [x for x in self.folders if x not in gone]
            if gone:
                self._commit()  # named no more before they go
            known = used | {p for _, p in self.folders}
            left = [f"{self.path}/{kind}/{name}" for kind in ("log", "base", "history") for name in names_in(self.spark, f"{self.path}/{kind}")]
            freed = 0
            for p in {p for _, p in gone} | {p for p in left if p not in known}:
                freed += 1
                remove(self.spark, p)
            for n, _ in gone:
                if self.cache is not None and n != self.version.number:
                    self.cache.invalidate(n)
            told = {"versions_removed": len(gone), "oldest_removed": min((n for n, _ in gone), default=0), "folders_removed": freed, "timestamp": time.time()}
        self._callback("on_gc", told)
        return told


class ParquetStorage:
    """The store that comes with the engine: a folder per save, with edges, nodes and metadata; the newest loads.

    A save counts once its metadata is there, so a half-written one is never loaded.
    """

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def save(self, data: graph.GraphData | DataFrame) -> None:
        data = graph.as_data(data)
        spark, at = data.edges.sparkSession, f"{self.path}/save-{time.time_ns():020}"
        data.edges.write.parquet(f"{at}/edges")
        graph.stored_nodes(spark.read.schema(schema.EDGES).parquet(f"{at}/edges"), data.nodes).write.parquet(f"{at}/nodes")
        write_text(spark, f"{at}/metadata.json", json.dumps({"metadata": data.metadata, "timestamp": time.time()}))

    def load(self, spark: SparkSession) -> graph.GraphData | None:
        for name in reversed(names_in(spark, self.path)):
            at = f"{self.path}/{name}"
            if "metadata.json" in names_in(spark, at):
                told = json.loads(read_text(spark, f"{at}/metadata.json"))
                return graph.GraphData(spark.read.schema(schema.EDGES).parquet(f"{at}/edges"), spark.read.schema(schema.STORED_NODES).parquet(f"{at}/nodes"), told["metadata"])
        return None
