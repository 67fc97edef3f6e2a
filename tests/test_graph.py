import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphtension.config import Config
from graphtension.errors import InvalidConfig, InvalidEvent, NotConverged, SnapshotClosed
from graphtension.operators import curvature, graph, hops, spectral, stats, temporal, tension
from graphtension.plans.engine import Engine
from graphtension.streaming import live


def edges(spark, rows):
    ev = spark.createDataFrame([(i, a, b, "test", float(w)) for i, (a, b, w) in enumerate(rows)], "seq bigint, src string, dst string, type string, weight double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    return graph.edges_of(ev)


def both(*pairs):
    return [x for a, b in pairs for x in ((a, b, 1), (b, a, 1))]


TRIANGLE = [("A", "B", 0.5), ("A", "C", 0.3), ("B", "C", 0.7)]
BRIDGE = both("AB", "AC", "BC", "DE", "DF", "EF", "CD")


def scores(spark, rows, kind="jsd"):
    return {r.node_id: r.tension for r in tension.tension(edges(spark, rows), kind).collect()}


def test_golden_tensions(spark):
    t = scores(spark, TRIANGLE)
    assert t["A"] == 0 and t["B"] == pytest.approx(0.418821231, abs=1e-8) and t["C"] == pytest.approx(0.109497629, abs=1e-8)
    assert scores(spark, TRIANGLE, "kl")["B"] == pytest.approx(23.960026709, abs=1e-6)
    assert scores(spark, TRIANGLE, "hellinger")["C"] == pytest.approx(0.228817933, abs=1e-8)
    assert scores(spark, [("B", "A", 1), ("B", "C", 1)])["A"] == pytest.approx(0.311278124, abs=1e-8)
    assert set(scores(spark, [("A", "B", 1), ("B", "A", 2)]).values()) == {0.0}


def literal(rows, v):
    """The definition, one neighbour at a time."""
    out = {}
    for a, b, w in rows:
        out.setdefault(a, {})
        out[a][b] = out[a].get(b, 0) + w
    near = {a for a, d in out.items() if v in d} | {n for n in out.get(v, {}) if n in out}
    norm = lambda x: x / x.sum() if x.sum() > 0 else np.full(len(x), 1 / len(x))

    def kl(p, q):
        return sum((x + 1e-12) * math.log2((x + 1e-12) / (y + 1e-12)) for x, y in zip(p, q) if x > 0)

    total = 0
    for n in near:
        names = sorted(out[n])
        w = np.array([out[n][x] for x in names], float)
        p, q = norm(w), norm(np.where(np.array(names) == v, 0.0, w))
        m = (p + q) / 2
        total += 0.5 * kl(p, m) + 0.5 * kl(q, m)
    return total / len(near) if near else 0.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ABCDE"), st.sampled_from("ABCDE"), st.sampled_from([0.0, 0.5, 1.0, 3.0])), min_size=1, max_size=14))
def test_closed_form_is_the_definition(spark, rows):
    got = scores(spark, rows)
    live_graph = live.LiveGraph()
    for a, b, w in rows:
        live_graph.add(a, b, w)
    for v, t in got.items():
        assert t == pytest.approx(literal(rows, v), abs=1e-8)
        assert live_graph.tension(v) == pytest.approx(t, abs=1e-9)


def test_curvature_and_spectrum(spark):
    k = {(r.src, r.dst): r.curvature for r in curvature.edge_curvature(edges(spark, BRIDGE), 0.5).collect()}
    assert k["C", "D"] == pytest.approx(-0.333333, abs=1e-5) and k["A", "B"] == pytest.approx(0.748308, abs=1e-5)
    path = both("AB", "BC", "CD")
    assert spectral.fiedler_value(edges(spark, path)).first().value == pytest.approx(2 - math.sqrt(2), abs=1e-9)
    assert hops.fiedler_approx(edges(spark, path)).first().value == pytest.approx(1 / 36, abs=1e-9)
    b = hops.betti(edges(spark, BRIDGE)).first()
    assert (b.beta0, b.beta1) == (1, 2)


def plain_curvature(rows, x, y, alpha):
    """The definition: lazy walks of both ends, hop distances by search, entropic transport by plain loops."""
    near = {}
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def walk(v):
        mass = {v: alpha}
        for n in near[v]:
            mass[n] = mass.get(n, 0) + (1 - alpha) / len(near[v])
        return mass

    def far(a):
        seen, edge, d = {a: 0}, [a], 0
        while edge:
            d += 1
            edge = [n for v in edge for n in near[v] if n not in seen and not seen.setdefault(n, d) < d]
        return seen

    mu, nu = walk(x), walk(y)
    ids = sorted({x, y} | near[x] | near[y])
    cost = {(i, j): float(far(i)[j]) for i in ids for j in ids}
    kern = {k: math.exp(-c / 0.1) for k, c in cost.items()}
    u, v = dict.fromkeys(ids, 1.0), dict.fromkeys(ids, 1.0)
    for _ in range(100):
        for j in ids:
            d = sum(kern[i, j] * u[i] for i in ids)
            v[j] = nu.get(j, 0) / d if d > 1e-300 else 0.0
        for i in ids:
            d = sum(kern[i, j] * v[j] for j in ids)
            u[i] = mu.get(i, 0) / d if d > 1e-300 else 0.0
    return 1 - sum(u[i] * kern[i, j] * v[j] * cost[i, j] for i in ids for j in ids)


def test_curvature_and_fiedler_are_their_definitions(spark):
    rng = np.random.default_rng(8)
    rows = [(f"n{a}", f"n{b}", float(rng.integers(1, 4))) for a, b in {tuple(rng.integers(0, 9, 2).tolist()) for _ in range(20)}]
    e = edges(spark, rows)
    got = {(r.src, r.dst): r.curvature for r in curvature.edge_curvature(e, 0.5).collect()}
    want = {(a, b): plain_curvature(rows, a, b, 0.5) for a, b, _ in rows}
    assert got == pytest.approx(want, abs=1e-6)
    node = {r.node_id: r.curvature for r in curvature.node_curvature(curvature.edge_curvature(e, 0.5)).collect()}
    for v in node:
        mine = [k for (a, b), k in want.items() if v in (a, b)]
        assert node[v] == pytest.approx(sum(mine) / len(mine), abs=1e-6)
    ring = both(*[(f"{i}", f"{(i + 1) % 7}") for i in range(7)], "03")
    lap = np.zeros((7, 7))
    for a, b, w in ring:
        lap[int(a), int(b)] = -w
    np.fill_diagonal(lap, -lap.sum(1))
    assert spectral.fiedler_value(edges(spark, ring)).first().value == pytest.approx(np.linalg.eigvalsh(lap)[1], abs=1e-9)


def test_replay_is_the_graph_after_each_event(spark):
    rng = np.random.default_rng(9)
    rows = [(f"n{a}", f"n{b}", float(w)) for a, b, w in rng.integers(0, 6, (25, 3)).tolist()]
    df = spark.createDataFrame([("g", i, a, b, w) for i, (a, b, w) in enumerate(rows)], "graph_id string, seq bigint, src string, dst string, weight double")
    last = {}
    for r in live.replay(df).collect():
        assert r.tension == pytest.approx(literal(rows[: r.seq + 1], r.node_id), abs=1e-8)
        assert r.previous == last.get(r.node_id)
        last[r.node_id] = r.tension


def test_levels_go_to_the_end_of_a_chain(spark):
    far = hops.levels(edges(spark, [(f"{i:03}", f"{i + 1:03}", 1) for i in range(66)]), "000")
    assert {r.id: r.hop for r in far.collect()} == {f"{i:03}": i for i in range(67)}


def test_co_occurrence_is_brute_force(spark):
    rows = [(f"u:{u}", f"t:{t}", 1) for u in range(12) for t in range(4) if u % 3 == t % 3 or u == 5 or t == 1] + [("t:1", "u:1", 1), ("t:2", "u:1", 1), ("u:1", "u:1", 1)]
    sets = {}
    for a, b, _ in rows:
        sets.setdefault(a, set()).add(b)
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = graph.co_occurrence(edges(spark, rows)).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.shared for r in got} == want


def test_fiedler_value_of_a_large_graph_with_hubs(spark):
    rng, n = np.random.default_rng(4), spectral.DENSE + 100
    rows = [x for u in range(n) for t in range(3) for w in [float(rng.uniform(5, 15))] for x in ((f"u:{u}", f"t:{t}", w), (f"t:{t}", f"u:{u}", w))]
    names = {v: i for i, v in enumerate(sorted({a for a, _, _ in rows}))}
    lap = np.zeros((len(names), len(names)))
    for a, b, w in rows:
        lap[names[a], names[b]] = -w
    np.fill_diagonal(lap, -lap.sum(axis=1))
    e = edges(spark, rows)
    assert spectral.fiedler_value(e).first().value == pytest.approx(np.linalg.eigvalsh(lap)[1], rel=1e-9)
    with pytest.raises(NotConverged):
        spectral._davidson(spectral._weighted(e), n + 3, 2, 1e-8)
    assert spectral.fiedler_value(e.unionByName(edges(spark, both("AB")))).first().value == 0


def test_concealment_grows_with_hops(spark):
    e = edges(spark, both("AB", "BC", "CD", "DE"))
    ids = spark.createDataFrame([("A",)], "id string")
    got = [hops.concealment(e, tension.tension(e), ids, 1.0, d).first().concealment for d in range(3)]
    assert got == pytest.approx([0.311278, 0.368535, 0.410661], abs=1e-5)


def test_scalars(spark):
    assert stats.yharim_limit(0.05) == pytest.approx(2.448, abs=1e-3) and stats.yharim_limit(0) == math.inf and stats.yharim_limit(1) == 0
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "tension double")
    m = stats.MadCalibrator(k=2, warmup=5).fit(df)
    assert (m.median, m.mad, m.threshold) == (3, 1, 5)
    now, before = (spark.createDataFrame(x, "node_id string, tension double") for x in ([("A", 0.5), ("B", 0.8)], [("A", 0.1), ("B", 0.7)]))
    assert temporal.indicators(now, before, 1.0).first().tension_spike == pytest.approx(0.4)
    for bad in ({"threshold": -1}, {"detectability_alpha": 1}, {"channel_size": 0}):
        with pytest.raises(InvalidConfig):
            Config(**bad)


def test_engine_versions(spark, tmp_path):
    seen = []
    e = Engine(spark, str(tmp_path), Config(compaction_threshold=4, cache_ttl_s=60, threshold=0.01, callbacks={"on_compact": seen.append}))
    e.add_events([("alice", "bob", "t", 1.0), ("bob", "carol", "t", 2.0)])
    old = e.snapshot()
    with pytest.raises(InvalidEvent):
        e.add_events([("x", "y"), ("", "y")])
    e.add_events([("carol", "alice", "t", 1.5), ("alice", "dave", "t", 1.0), ("dave", "bob", "t", 0.5)])
    assert seen and seen[0]["overlay_before"] == 9
    with e.snapshot() as s:
        assert (s.node_count(), s.edge_count()) == (4, 5)
        assert s.analyze_node("dave").tension == pytest.approx(0.155639062, abs=1e-8)
        assert s.get_edge("alice", "bob").weight == 1.0
    assert old.edge_count() == 2
    old.close()
    with pytest.raises(SnapshotClosed):
        old.node_count()
    assert e.stats()["distinct_edges"] == 5
    e.reset()
    assert e.snapshot().edge_count() == 0


def test_replay_stream_is_replay(spark, tmp_path):
    rows = [("g", i, a, b, float(w)) for i, (a, b, w) in enumerate(BRIDGE)]
    df = spark.createDataFrame(rows, "graph_id string, seq bigint, src string, dst string, weight double")
    want = {(r.seq, r.node_id): r.tension for r in live.replay(df).collect()}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = live.replay_stream(stream).writeStream.format("memory").queryName("replayed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.seq, r.node_id): r.tension for r in spark.table("replayed").collect()} == pytest.approx(want)


def sent_to_python(df):
    """Bytes that the plan that ran gave to Python workers."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return walk(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
        m, below = plan.metrics().get("pythonDataSent"), plan.children()
        return (m.get().value() if m.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_tension_arrays_holds_a_hub_once(spark):
    """2000 targets at a hub: 2000 x 2000 shares, if each edge carries those of the hub."""
    e = edges(spark, both(*[("hub", f"v{i}") for i in range(2000)]))
    assert 0 < sent_to_python(tension.tension_arrays(e, lambda p, q: abs(p - q).sum() / 2)) < 2_000_000


def test_tension_arrays_in_pieces(spark, monkeypatch):
    """Pieces of two targets, edges given twice, sources without weight, edges that don't lead back."""
    monkeypatch.setattr(tension, "TARGETS", 2)
    monkeypatch.setattr(tension, "WORK", 1)
    monkeypatch.setattr(tension, "HELD", 4)
    rng = np.random.default_rng(5)
    rows = [("abcdefg"[i], "abcdefgh"[j], float(w)) for i, j, w in zip(rng.integers(0, 7, 30), rng.integers(0, 8, 30), rng.choice([0.0, 0.5, 3.0], 30), strict=True)] + [("z", "a", 0.0), ("z", "b", 0.0)]
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    got = {r.node_id: r.tension for r in tension.tension_arrays(e, lambda p, q: float((np.arange(1, len(p) + 1) * abs(p - q)).sum()) + (1.0 if np.array_equal(p, q) else 0.0)).collect()}
    out = {}
    for a, b, w in sorted(rows):
        out.setdefault(a, []).append((b, w))
    norm = lambda x: x / x.sum() if x.sum() > 0 else np.full(len(x), 1 / len(x))
    assert set(got) == {x for a, b, _ in rows for x in (a, b)}
    for v, t in got.items():
        near = {a for a in out if v in dict(out[a])} | {b for b, _ in out.get(v, []) if b in out}
        each = []
        for n in near:
            w = np.array([x for _, x in out[n]])
            p, q = norm(w), norm(np.where(np.array([b for b, _ in out[n]]) == v, 0.0, w))
            each.append((np.arange(1, len(p) + 1) * abs(p - q)).sum() + np.array_equal(p, q))
        assert t == pytest.approx(np.mean(each) if each else 0.0, abs=1e-9)


def test_co_occurrence_deals_a_large_group(spark, monkeypatch):
    """300 sources alike, in blocks of 16: every pair once, and no task has most of them."""
    monkeypatch.setattr(graph, "BLOCK", 16, raising=False)
    rows = [(f"u:{u}", t, 1) for u in range(300) for t in "xyz"] + [(f"v:{u}", t, 1) for u in range(40) for t in "zw"] + [("w", "w", 1)]
    sets = {}
    for a, b, _ in rows:
        sets.setdefault(a, set()).add(b)
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = graph.co_occurrence(edges(spark, rows)).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.shared for r in got} == want
    assert max(sum(r.task == k for r in got) for k in {r.task for r in got}) < 0.5 * len(got)


def test_curvature_of_twins(spark):
    """Leaves of two hubs alike, a clique with loops, a loop alone: by definition, and once for each two classes."""
    rows = [(f"u{i}", t, 1) for i in range(6) for t in ("s", "t")] + [(f"c{i}", f"c{j}", 1) for i in range(3) for j in range(3)]
    rows += [("c0", "t", 1), ("t", "c1", 1), ("c2", "t", 1), ("z", "z", 1), ("s", "s", 1), ("w", "u3", 1), ("x", "y", 1)]
    got = {(r.src, r.dst): r.curvature for r in curvature.edge_curvature(edges(spark, rows), 0.5).collect()}
    assert got == pytest.approx({(a, b): plain_curvature(rows, a, b, 0.5) for a, b, _ in rows}, abs=1e-9)


def test_curvature_holds_twins_once(spark):
    """200 leaves of three hubs: 1200 edges, each with a support of some 200 nodes, are 2 pairs of classes."""
    rows = both(*[(f"u{i}", t) for i in range(200) for t in "rst"])
    assert 0 < sent_to_python(curvature.edge_curvature(edges(spark, rows), 0.5)) < 20_000


def test_node_curvature_of_twins(spark):
    rows = both(*[(f"u{i}", t) for i in range(60) for t in "rst"]) + [("u0", "u0", 1)]
    c = curvature.edge_curvature(edges(spark, rows), 0.5)
    got = curvature.node_curvature(c)
    assert sent_to_python(got) < 20_000
    want = {}
    for a, b, _ in rows:
        if a == b or "u0" in (a, b) or "u1" in (a, b):
            want[a, b] = plain_curvature(rows, a, b, 0.5)
    u1 = [want["u1", t] for t in "rst"] + [want[t, "u1"] for t in "rst"]
    r = [want["u0", "r"], want["r", "u0"]] + 59 * [want["u1", "r"], want["r", "u1"]]
    u0 = [want["u0", t] for t in "rst"] + [want[t, "u0"] for t in "rst"] + [want["u0", "u0"]]
    mean = {x.node_id: x.curvature for x in got.collect()}
    assert len(mean) == 63 and all(mean[v] == pytest.approx(sum(k) / len(k), abs=1e-9) for v, k in (("u1", u1), ("u59", u1), ("r", r), ("u0", u0)))
