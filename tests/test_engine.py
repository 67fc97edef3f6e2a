"""The engine over several batches, versions and restarts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphtension.config import Config
from graphtension.errors import EngineRunning, EngineStopped, InvalidConfig
from graphtension.operators import graph, stats, temporal
from graphtension.plans import analyze
from graphtension.plans.engine import Engine, ParquetStorage
from graphtension.schema import DELTA_TYPES as D
from graphtension.schema import EVENTS
from graphtension.streaming import live

QUIET = {"upkeep_s": 0}


def feed(seen):
    return lambda df: seen.extend(r.asDict() for r in df.collect())


def test_changes_are_told_against_the_graph_before(spark, tmp_path):
    seen = []
    e = Engine(spark, str(tmp_path), Config(**QUIET, callbacks={"on_change": feed(seen)}))
    e.add_events([("a", "b", "t", 2.0)])
    e.add_events([("a", "b", "t", 5.0), ("a", "c", "t", 1.0), ("c", "c", "t", 1.0), ("a", "c", "t", 3.0)])
    edges = [(r["type"], r["edge_from"], r["edge_to"], r["previous"], r["weight"]) for r in sorted(seen, key=lambda r: r["version"]) if r["edge_from"]]
    assert edges == [(D["edge_added"], "a", "b", 0, 2), (D["edge_updated"], "a", "b", 2, 7), (D["edge_added"], "a", "c", 0, 1), (D["edge_added"], "c", "c", 0, 1), (D["edge_updated"], "a", "c", 1, 4)]
    assert sorted((r["version"], r["node_id"]) for r in seen if r["type"] == D["node_added"]) == [(1, "a"), (1, "b"), (3, "c")]
    e.compact()
    seen.clear()
    e.add_events([("a", "b", "t", 1.0)])  # existence is looked up in the overlay alone
    assert [r["type"] for r in seen if r["edge_from"]] == [D["edge_added"]]


def test_trends_and_anomalies_are_changes_too(spark, tmp_path):
    seen, odd, spikes = [], [], []
    e = Engine(spark, str(tmp_path), Config(**QUIET, threshold=0.1, callbacks={"on_change": feed(seen), "on_anomaly": feed(odd), "on_tension_spike": feed(spikes)}))
    e.add_events([("n", "v", "t", 1.0), ("n", "w", "t", 9.0)])
    e.add_events([("n", "v", "t", 90.0)])
    turned = [r for r in seen if r["type"] == D["tension_changed"]]
    found = [r for r in seen if r["type"] == D["anomaly_detected"]]
    assert [r["node_id"] for r in turned] == ["v"] and turned[0]["tension"] > 0.3
    assert {(r["version"], r["node_id"]) for r in found} == {(r["version"], r["node_id"]) for r in odd} >= {(3, "v")}
    assert [r["node_id"] for r in spikes] == ["v"]


def test_calibrator_learns_from_the_first_observations_of_all_batches(spark):
    cal = stats.MadCalibrator(warmup=5)
    frame = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "tension double")
    assert not cal.fit(frame([0.1] * 4)).warm
    cal.fit(frame([9.0, 9.5]))
    assert (cal.median, cal.mad, cal.observed) == (pytest.approx(0.1), 0, 6)
    cal.fit(frame([50.0] * 9))
    assert cal.median == pytest.approx(0.1) and cal.recalibrate(frame([1, 2, 3, 4, 5])).threshold == 6
    again = stats.MadCalibrator(warmup=3)
    again.restore(stats.MadCalibrator(warmup=3).fit(frame([1.0])).state())
    assert again.fit(frame([1.0, 4.0])).median == 1.0


def test_an_engine_goes_on_after_a_restart(spark, tmp_path):
    nodes = spark.createDataFrame([("lone", "island", {"x": 1.5}), ("a", "person", {"age": 7.0})], "id string, type string, attributes map<string,double>")
    base = graph.GraphData(graph.edges_of(spark.createDataFrame([(0, "a", "b", "old", 2.0, None)], "seq bigint, src string, dst string, type string, weight double, ts timestamp")), nodes)
    cal = stats.MadCalibrator(warmup=100)
    told = {"callbacks": {"on_anomaly": lambda _: None}}
    store = ParquetStorage(f"{tmp_path}/store")
    e = Engine(spark, f"{tmp_path}/e", Config(**QUIET, base_graph=base, calibrator=cal, storage=store, **told))
    e.add_events([("a", "b", "new", 1.0), ("b", "c", "new", 4.0)])
    e.add_events([("c", "a", "new", 2.0)])
    again = Engine(spark, f"{tmp_path}/e", Config(**QUIET, calibrator=stats.MadCalibrator(warmup=100), **told))
    assert again.version == e.version and again.events_total == 3 and again.config.calibrator.state() == cal.state()
    with again.snapshot() as s:
        got = {r.id: r for r in s.nodes.collect()}
        assert s.node_count() == 4 and got["lone"].degree == 0 and got["lone"].type == "island" and got["a"].attributes == {"age": 7.0} and got["a"].type == "person"
        assert s.get_edge("a", "b").weight == 3.0 and s.get_edge("a", "b").type == "new"
    assert again.stats()["distinct_nodes"] == 4 and again.stats()["base_nodes"] == 3
    again.config = Config(**QUIET, storage=store)
    again.compact()
    assert again.snapshot().get_edge("a", "b").type == "old"
    # a store that another process reads, and a half-written save that doesn't count
    base.edges.write.parquet(f"{tmp_path}/store/save-99999999999999999999/edges")
    fresh = Engine(spark, f"{tmp_path}/f", Config(**QUIET, storage=ParquetStorage(f"{tmp_path}/store")))
    with fresh.snapshot() as s:
        assert s.edge_count() == 3 and {r.id: r.type for r in s.nodes.collect()} == {"lone": "island", "a": "person", "b": "", "c": ""}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/e", Config(**QUIET, channel_size=3))
    df = spark.createDataFrame([(i, "a", f"n{i % 4}", "t", 1.0, None, None) for i in range(8)], EVENTS)
    assert e.add_frame(df, "s", 4) and not e.add_frame(df, "s", 4) and not e.add_frame(df, "s", 3) and e.add_frame(df, "other", 0)
    assert Engine(spark, f"{tmp_path}/e", Config(**QUIET)).streams == {"s": 4, "other": 0}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).options(**live.source_limits(e.config)).parquet(f"{tmp_path}/in")
    two = Engine(spark, f"{tmp_path}/two", Config(**QUIET, channel_size=3))
    q = live.into_engine(stream, two, f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert two.version.number == 8 and len(two.version.batches) == 3 and two.snapshot().edges.agg(F.sum("cnt")).first()[0] == 8


def test_upkeep(spark, tmp_path):
    gone = []
    e = Engine(spark, f"{tmp_path}/e", Config(**QUIET, cache_ttl_s=60, compaction_strategy="manual", callbacks={"on_gc": gone.append, "on_error": gone.append}))
    e.add_events([("a", "b"), ("b", "c")])
    held = e.snapshot()
    first = held.analyze()
    assert held.analyze() is first and e.cache.stats()["hits"] == 1 and e.cache.stats()["bytes"] > 0
    e.compact()
    e.add_events([("c", "d")])
    assert e.gc()["versions_removed"] == 0  # the open snapshot reads the first batch
    assert held.edge_count() == 2
    assert first.tensions.count() == 3
    held.close()
    assert e.gc()["versions_removed"] == 1 and e.snapshot().edge_count() == 3
    assert len(list((tmp_path / "e" / "log").iterdir())) == 1
    out = e.analyze()
    assert sum(map(len, e.snapshots.values())) == 1 and out.written and out.tensions.count() == 4
    with pytest.raises(EngineRunning):
        e.start()
    e.stop()
    with pytest.raises(EngineStopped):
        e.stop()
    bad = Engine(spark, f"{tmp_path}/g", Config(**QUIET, callbacks={"on_change": lambda _: 1 / 0, "on_error": gone.append}))
    bad.add_events([("a", "b")])
    assert isinstance(gone[-1], ZeroDivisionError) and bad.version.number == 1


def test_upkeep_runs_by_itself(spark, tmp_path):
    import time

    told = []
    e = Engine(spark, str(tmp_path), Config(upkeep_s=0.2, callbacks={"on_gc": told.append}))
    e.start()
    time.sleep(2)
    e.stop()
    assert told
    n = len(told)
    time.sleep(1)
    assert len(told) <= n + 1


def test_history_is_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("graphtension.plans.engine.HISTORIES", 2)
    e = Engine(spark, str(tmp_path), Config(**QUIET, temporal_capacity=3, callbacks={"on_anomaly": lambda _: None}))
    for i in range(5):
        e.add_events([("a", "b", "t", 1.0 + i)])
    h = e.tension_history().filter("node_id = 'b'").collect()
    assert sorted(r.version for r in h) == [3, 4, 5] and len(e.history) <= 2
    rows = e.snapshot().analyze(dt=1.0)
    assert rows.temporal.count() == 1 and e.previous_tensions().count() == 2


def test_one_json_document(spark, tmp_path):
    nodes = spark.createDataFrame([("lone", 'q"x', {"x": 1.5})], "id string, type string, attributes map<string,double>")
    e = Engine(spark, f"{tmp_path}/e", Config(**QUIET, base_graph=graph.GraphData(graph.edges_of(spark.createDataFrame([(0, "a", "b", "t", 2.0, None), (1, "b", "c", "", 1.0, None)], "seq bigint, src string, dst string, type string, weight double, ts timestamp")), nodes)))
    with e.snapshot() as s:
        s.export(f"{tmp_path}/out")
        with pytest.raises(InvalidConfig):
            s.export(f"{tmp_path}/no", "png")
    read = lambda at: json.loads("\n".join(p.read_text() for p in sorted(at.glob("part-*"))))
    doc = read(tmp_path / "out")
    assert {n["id"]: n.get("attributes") for n in doc["nodes"]} == {"a": None, "b": None, "c": None, "lone": {"x": 1.5}}
    assert sorted((x["from"], x["to"], x["weight"], x.get("type"), x["count"]) for x in doc["edges"]) == [("a", "b", 2.0, "t", 1), ("b", "c", 1.0, None, 1)]
    with Engine(spark, f"{tmp_path}/empty", Config(**QUIET)).snapshot() as s:
        s.export(f"{tmp_path}/none")
    assert read(tmp_path / "none") == {"nodes": None, "edges": None}


def test_relative_weight_is_the_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(temporal, "CHUNK", 3)
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 3}", i, float(rng.integers(0, 4))) for i in range(60)] + [("one", 99, 2.0)]
    got = {(r.src, r.seq): r.relative for r in temporal.relative_weight(spark.createDataFrame(rows, "src string, seq bigint, weight double"), 5).collect()}
    ema, want = {}, {}
    for s, i, w in rows:
        ema[s] = w if s not in ema else w / 3 + ema[s] * 2 / 3
        want[s, i] = w / ema[s] if ema[s] > 0 else 0.0
    assert got == pytest.approx(want)


def test_topology_and_shock_are_carried(spark):
    ev = spark.createDataFrame([(i, a, b, "t", 1.0, None) for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "a")])], "seq bigint, src string, dst string, type string, weight double, ts timestamp")
    e = graph.edges_of(ev)
    before = spark.createDataFrame([("a", 0.5), ("gone", 0.1)], "node_id string, tension double")
    out = analyze.analyze(e, Config(topology=lambda nodes, edges: nodes.agg(F.count(F.lit(1)).alias("n"))), before, 1.0)
    assert out.topology.first().n == 3 and out.temporal.first().velocity >= 0
    curv = lambda x: spark.createDataFrame([("a", "b", x)], "src string, dst string, curvature double")
    row = analyze.temporal_block(e, out.tensions, before, 1.0, Config(), curvature=(curv(0.5), curv(-0.25))).first()
    assert row.curvature_shock == 0.75
