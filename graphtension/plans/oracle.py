"""DuckDB text for the driver's check: common table expressions over the same tables, and one query for each key."""

from __future__ import annotations

EV1 = """ev AS (SELECT event_id AS seq, 'u:' || p AS src, 'u:' || user_id AS dst, event_type AS type, value AS weight, ts
  FROM (SELECT *, lag(user_id) OVER (ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL)"""
EV2 = """ev AS (SELECT event_id AS seq, 'u:' || user_id AS src, 't:' || event_type AS dst, event_type AS type, value AS weight, ts FROM events
  UNION ALL SELECT event_id, 't:' || event_type, 'u:' || user_id, event_type, value, ts FROM events)"""
FOLD = "SELECT src, dst, sum(weight) AS weight, arg_min(type, seq) AS type, count(*) AS cnt, min(ts) AS first_seen, max(ts) AS last_seen FROM {} GROUP BY src, dst"
EDGES = f"edges AS ({FOLD.format('ev')})"
NODES = """nodes AS (SELECT id, split_part(id, ':', 1) AS type, sum(o) + sum(i) AS degree, sum(i) AS in_degree, sum(o) AS out_degree, min(first_seen) AS first_seen, max(last_seen) AS last_seen
  FROM (SELECT src AS id, 1 AS o, 0 AS i, first_seen, last_seen FROM edges UNION ALL SELECT dst, 0, 1, first_seen, last_seen FROM edges) GROUP BY id)"""
UND = "und AS (SELECT src AS v, dst AS n FROM edges UNION SELECT dst, src FROM edges)"
FORMS = {
    "jsd": """CASE WHEN rest THEN 0.5 * (s + CASE WHEN s < 1 THEN (1 - s) * log2((1 - s) / (1 - s / 2)) ELSE 0 END - log2(1 - s / 2))
      ELSE 0.5 * log2(2.0 * k / (k + 1)) + 0.5 * (log2(2.0 / (k + 1)) / k + (k - 1.0) / k) END""",
    "kl": "CASE WHEN rest THEN (s + 1e-12) * log2((s + 1e-12) / 1e-12) + CASE WHEN s < 1 THEN (1 - s) * log2(1 - s) ELSE 0 END ELSE log2(k) END",
    "hellinger": "CASE WHEN rest THEN sqrt(greatest(0, 1 - sqrt(greatest(0, 1 - s)))) ELSE sqrt(1 - sqrt(1.0 / k)) END",
    "tv": "CASE WHEN rest THEN s ELSE 1 - 1.0 / k END",
}


def tension(kind: str = "jsd", edges: str = "edges", name: str = "tension") -> str:
    """CTEs that end in ``name`` (node_id, tension)."""
    p = f"{name}_"
    return f"""{p}o AS (SELECT src, sum(weight) AS tot, count(*) AS k, count(*) FILTER (weight > 0) AS npos FROM {edges} GROUP BY src),
{p}i AS (SELECT e.src AS n, e.dst AS v, e.weight AS w, o.k, CASE WHEN o.tot > 0 THEN e.weight / o.tot ELSE 0 END AS s, o.npos - (e.weight > 0)::INT > 0 AS rest FROM {edges} e JOIN {p}o o USING (src)),
{p}num AS (SELECT v, sum(CASE WHEN w > 0 THEN {FORMS[kind]} ELSE 0 END) AS num FROM {p}i GROUP BY v),
{p}den AS (SELECT v, count(*) AS den FROM (SELECT v, n FROM {p}i UNION SELECT e.src, e.dst FROM {edges} e WHERE e.dst IN (SELECT src FROM {p}o)) GROUP BY v),
{p}ids AS (SELECT src AS id FROM {edges} UNION SELECT dst FROM {edges}),
{name} AS (SELECT id AS node_id, coalesce(greatest(num, 0) / den, 0) AS tension FROM {p}ids LEFT JOIN {p}den d ON d.v = id LEFT JOIN {p}num m ON m.v = id)"""


def w(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


G1, G2 = (EV1, EDGES), (EV2, EDGES)
T1, T2 = (*G1, tension()), (*G2, tension())
R = "round({0}, 6) + 0.0 AS {1}"
US = "epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us"
EDGE = f"src, dst, round(weight, 4) AS weight, type, cnt, {US}"
BASE = f"base AS ({FOLD.format('ev WHERE seq % 3 = 0')}), over AS ({FOLD.format('ev WHERE seq % 3 <> 0')})"
NODE_OF = "SELECT id, count(*) FILTER (o = 1) + count(*) FILTER (i = 1) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM {0} UNION ALL SELECT dst, 0, 1 FROM {0}) GROUP BY id"
LAYERS = f"{BASE}, bn AS ({NODE_OF.format('base')}), oon AS ({NODE_OF.format('over')})"
MERGE = """SELECT coalesce(b.src, o.src) AS src, coalesce(b.dst, o.dst) AS dst, coalesce(b.weight, 0) + coalesce(o.weight, 0) AS weight, coalesce({0}.type, {1}.type) AS type,
  coalesce(b.cnt, 0) + coalesce(o.cnt, 0) AS cnt, least(b.first_seen, o.first_seen) AS first_seen, greatest(b.last_seen, o.last_seen) AS last_seen
  FROM base b FULL OUTER JOIN over o ON b.src = o.src AND b.dst = o.dst"""
#: Samples of the bipartite graph: the tension after each of five growing parts of the log.
HIST = ", ".join(f"he{i} AS ({FOLD.format(f'ev WHERE seq % 5 <= {i}')}), {tension('jsd', f'he{i}', f'ht{i}')}" for i in range(5)) + ", history AS (" + " UNION ALL ".join(f"SELECT node_id, {i + 1} AS version, tension FROM ht{i}" for i in range(5)) + ")"
HOPS = """d0 AS (SELECT id AS source, id, 0 AS hop FROM nodes WHERE id IN ('u:1', 'u:7', 't:click')),
d1 AS (SELECT DISTINCT source, n AS id, 1 AS hop FROM d0 JOIN und ON v = id WHERE n <> source),
d2 AS (SELECT DISTINCT source, n AS id, 2 AS hop FROM d1 JOIN und ON v = d1.id WHERE (source, n) NOT IN (SELECT (source, id) FROM d0 UNION SELECT (source, id) FROM d1)),
hops AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)"""
TREND = "CASE WHEN {0} > 0.01 THEN 1 WHEN {0} < -0.01 THEN 2 ELSE 0 END"
SNR = "CASE WHEN count({0}) = 0 OR avg({0}) = 0 THEN 0 WHEN stddev_pop({0}) = 0 THEN NULL ELSE avg({0}) / stddev_pop({0}) * sqrt(count({0})) END"
LIMIT = "sqrt(2 * ln(1 / 0.05))"
REGION = f"CASE WHEN snr > 2 * {LIMIT} THEN 2 WHEN snr > {LIMIT} THEN 1 ELSE 0 END"
STATS = f"""count(*) AS nodes_analyzed, {R.format('avg(tension)', 'mean')}, {R.format('median(tension)', 'median')}, {R.format('greatest(max(tension), 0)', 'max')},
 {R.format('stddev_pop(tension)', 'stddev')}, count(*) FILTER (anomaly) AS anomaly_count, {R.format('count(*) FILTER (anomaly) / count(*)', 'anomaly_rate')}"""
CONC = "conc AS (SELECT source AS node_id, sum(tension * exp(-0.5 * hop)) AS concealment FROM hops JOIN tension ON hops.id = tension.node_id GROUP BY source)"
MAD = "med AS (SELECT median(tension) AS median FROM tension), mad AS (SELECT median(abs(tension - median)) AS mad FROM tension, med), cal AS (SELECT median, mad, median + 3 * mad AS threshold FROM med, mad)"
IND = """now AS (SELECT * FROM ht4), bef AS (SELECT * FROM ht1),
spike AS (SELECT max(abs(coalesce(n.tension, 0) - coalesce(b.tension, 0))) AS spike FROM now n FULL OUTER JOIN bef b USING (node_id)),
c AS (SELECT avg(tension) AS c FROM now), p AS (SELECT avg(tension) AS p FROM bef), ind AS (SELECT spike, -(ln(c) - ln(p)) / 60.0 AS decay, c FROM spike, c, p)"""
PHASE = """pr AS (SELECT spike, decay, least((CASE WHEN decay < 0 THEN abs(decay) WHEN decay < 0.01 AND c > 0 THEN c ELSE 0 END) + spike, 2.0) AS rho, ratio AS pi FROM ind,
 (SELECT avg((node_id IN (SELECT node_id FROM now))::INT) AS ratio FROM bef))"""
BAD = """bad AS (SELECT event_id AS seq, CASE WHEN event_id % 97 = 0 THEN '' ELSE 'u:' || user_id END AS src, CASE WHEN event_id % 89 = 0 THEN '' ELSE 't:' || event_type END AS dst,
 CASE WHEN event_id % 83 = 0 THEN -value WHEN event_id % 79 = 0 THEN 0 ELSE value END AS weight FROM events)"""
ERR = "CASE WHEN src = '' THEN 'empty source' WHEN dst = '' THEN 'empty target' WHEN weight < 0 THEN 'negative weight' END"
QUOTE = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
ANALYZE = "SELECT node_id, {0}, degree::BIGINT AS degree, tension > 0.05 AS anomaly, {1} FROM tension JOIN nodes ON id = node_id".format(R.format("tension", "tension"), R.format("CASE WHEN degree > 0 THEN least(1.0, degree / 10.0) ELSE 0 END", "confidence"))
N1, N2 = (*G1, NODES), (*G2, NODES)
HN2 = (*T2, NODES, UND, HOPS)

ORACLE: dict[str, str] = {
    "ingest_validate": w(BAD) + f"SELECT seq, {ERR} AS error FROM bad",
    "ingest_normalize": w(BAD) + "SELECT seq, CASE WHEN weight = 0 THEN 1.0 ELSE weight END AS weight FROM bad WHERE src <> '' AND dst <> '' AND weight >= 0",
    "ingest_batch_validity": w(BAD, f"e AS (SELECT seq // 1000 AS batch, {ERR} AS error FROM bad)") + "SELECT batch, count(*) AS events, count(error) AS invalid, count(error) = 0 AS accepted FROM e GROUP BY batch",
    "weight_func_scaled": w(EV2) + "SELECT src, dst, round(sum(CASE WHEN type = 'purchase' THEN weight * 2 ELSE weight END), 4) AS weight FROM ev GROUP BY src, dst",
    "node_type_prefix": w(*N2) + "SELECT type, count(*) AS nodes FROM nodes GROUP BY type",
    "edges_agg": w(*G1) + f"SELECT {EDGE} FROM edges",
    "nodes_agg": w(*N1) + f"SELECT id, type, degree::BIGINT AS degree, {US} FROM nodes",
    "node_upsert": w(EV2) + "SELECT src AS id, arg_max(type, seq) AS type, epoch_us(arg_max(ts, seq)) AS last_us FROM ev GROUP BY src",
    "degrees": w(*N1) + "SELECT id, degree::BIGINT AS degree, in_degree::BIGINT AS in_degree, out_degree::BIGINT AS out_degree FROM nodes",
    "out_neighbors": w(*G1) + "SELECT dst AS id FROM edges WHERE src = 'u:1'",
    "in_neighbors": w(*G1) + "SELECT src AS id FROM edges WHERE dst = 'u:1'",
    "neighbors_undirected": w(*G1, UND) + "SELECT v, n FROM und",
    "node_lookup": w(*N1) + f"SELECT id, degree::BIGINT AS degree, {US} FROM nodes WHERE id = 'u:1'",
    "edge_lookup": w(*G2) + f"SELECT {EDGE} FROM edges WHERE src = 'u:1' AND dst = 't:click'",
    "node_scan": w(*N2) + "SELECT id, type FROM nodes",
    "edge_scan": w(*G2) + "SELECT src, dst, cnt FROM edges",
    "graph_counts": w(*N1) + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges",
    "base_graph_union": w(EV2, BASE, f"m AS ({MERGE.format('o', 'b')})") + f"SELECT {EDGE} FROM m",
    "unified_nodes": w(EV1, LAYERS) + "SELECT id, degree FROM oon UNION ALL SELECT id, degree FROM bn WHERE id NOT IN (SELECT id FROM oon)",
    "unified_edges": w(EV1, BASE, f"m AS ({MERGE.format('o', 'b')})") + f"SELECT {EDGE} FROM m",
    "unified_counts": w(EV1, LAYERS, f"m AS ({MERGE.format('o', 'b')})") + "SELECT (SELECT count(*) FROM (SELECT id FROM bn UNION SELECT id FROM oon)) AS nodes, (SELECT count(*) FROM m) AS edges",
    "compact_edges": w(EV1, BASE, f"m AS ({MERGE.format('b', 'o')})") + f"SELECT {EDGE} FROM m",
    "compact_stats": w(EV1, LAYERS) + "SELECT (SELECT count(*) FROM bn WHERE id IN (SELECT id FROM oon)) AS nodes_merged, (SELECT count(*) FROM base SEMI JOIN over USING (src, dst)) AS edges_merged, (SELECT count(*) FROM oon) + (SELECT count(*) FROM over) AS overlay_before, 0::BIGINT AS overlay_after",
    "compaction_epochs": w(EV1) + "SELECT (seq - 1) // 1000 AS epoch, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM ev WHERE seq > 0 GROUP BY 1",
    "storage_roundtrip": w(*G2) + f"SELECT {EDGE} FROM edges",
    "bfs_hops": w(*N2, UND, HOPS) + "SELECT source, id, hop FROM hops",
    "normalize_out": w(*G1) + f"SELECT src, dst, {R.format('weight / sum(weight) OVER (PARTITION BY src)', 'share')} FROM edges",
    **{f"tension_{k}": w(*G1, tension(k)) + f"SELECT node_id, {R.format('tension', 'tension')} FROM tension" for k in ("jsd", "kl", "hellinger")},
    "tension_custom_tv": w(*G2, tension("tv")) + f"SELECT node_id, {R.format('tension', 'tension')} FROM tension",
    "tension_arrays": w(*G2, tension("tv")) + f"SELECT node_id, {R.format('tension', 'tension')} FROM tension",
    "anomaly_static": w(*T2) + "SELECT node_id, tension > 0.05 AS anomaly FROM tension",
    "anomaly_threshold_func": w(*T2) + "SELECT node_id, CASE WHEN node_id LIKE 't:%' THEN tension > 0.01 ELSE tension > 0.05 END AS anomaly FROM tension",
    "anomaly_mad": w(*T2, MAD) + "SELECT node_id, tension > threshold AS anomaly FROM tension, cal",
    "anomaly_priority": w(*T2, MAD) + "SELECT node_id, tension > 0.03 AS by_func, tension > threshold AS by_calibrator, tension > 0.05 AS by_static FROM tension, cal",
    "anomalies_only": w(*T2) + f"SELECT node_id, {R.format('tension', 'tension')} FROM tension WHERE tension > 0.05",
    "confidence": w(*N2) + f"SELECT id, {R.format('CASE WHEN degree > 0 THEN least(1.0, degree / 10.0) ELSE 0 END', 'confidence')} FROM nodes",
    "components": w(*T2) + f"SELECT node_id, {R.format('tension', 'tension')}, 0.0::DOUBLE AS curvature, 0.0::DOUBLE AS concealment FROM tension",
    "agg_mean": w(*T2) + f"SELECT {R.format('avg(tension)', 'value')} FROM tension",
    "agg_max": w(*T2) + f"SELECT {R.format('max(tension)', 'value')} FROM tension",
    "agg_median": w(*T2) + f"SELECT {R.format('median(tension)', 'value')} FROM tension",
    "agg_sum": w(*T2) + f"SELECT {R.format('sum(tension)', 'value')} FROM tension",
    "result_stats": w(*T2) + f"SELECT {STATS} FROM (SELECT *, tension > 0.05 AS anomaly FROM tension)",
    "region_nodes": w(*T2, "reg AS (SELECT * FROM (VALUES (0, 'u:1'), (1, 'u:7'), (2, 't:click'), (3, 'u:1'), (4, 'nobody')) t(pos, node_id))") + f"SELECT pos, node_id, {R.format('tension', 'tension')} FROM reg JOIN tension USING (node_id)",
    "region_stats": w(*T2) + f"SELECT {R.format('avg(tension)', 'mean')}, {R.format('greatest(max(tension), 0)', 'max')}, count(*) FILTER (tension > 0.05) AS anomaly_count FROM tension WHERE node_id IN ('u:1', 'u:7', 't:click')",
    "region_aggregated": w(*T2) + f"SELECT {R.format('median(tension)', 'aggregated')} FROM tension WHERE node_id IN ('u:1', 'u:7', 't:click')",
    "mad_threshold": w(*T2, MAD) + f"SELECT {R.format('median', 'median')}, {R.format('mad', 'mad')}, {R.format('threshold', 'threshold')} FROM cal",
    "mad_warmup": w(*T2, "first AS (SELECT tension FROM tension ORDER BY node_id LIMIT 50), med AS (SELECT median(tension) AS median FROM first), mad AS (SELECT median(abs(tension - median)) AS mad FROM first, med)") + "SELECT node_id, tension > median + 3 * mad AS anomaly FROM tension, med, mad",
    "mad_precomputed": w(*T2) + "SELECT node_id, tension > 0.02 + 2 * 0.01 AS anomaly FROM tension",
    "snr": w(*T2) + f"SELECT {R.format(SNR.format('tension'), 'snr')} FROM tension",
    "yharim": f"SELECT a AS alpha, {R.format('sqrt(2 * ln(1 / a))', 'value')} FROM (VALUES (0.05::DOUBLE), (0.01), (0.001), (0.5)) t(a)",
    "detectability": w(*T2, f"x AS (SELECT {SNR.format('tension')} AS snr FROM tension)") + f"SELECT {R.format('snr', 'snr')}, {R.format(LIMIT, 'threshold')}, {REGION} AS region, 0.05::DOUBLE AS alpha FROM x",
    "concealment": w(*HN2, CONC) + f"SELECT node_id, {R.format('concealment', 'concealment')} FROM conc",
    "concealment_set": w(*HN2, CONC) + f"SELECT {R.format('sum(concealment)', 'concealment')} FROM conc",
    "cps_region": w(*HN2, CONC, f"r AS (SELECT avg(tension) AS mean, {SNR.format('tension')} AS snr, sum(concealment) AS omega FROM tension JOIN conc USING (node_id))") + f"SELECT {R.format('mean', 'mean')}, {R.format('omega', 'omega')}, {R.format(f'CASE WHEN ({REGION}) > 0 AND omega > 0 AND mean > 0 THEN 2 / (1 + exp(-omega / mean)) - 1 ELSE 0 END', 'cps')} FROM r",
    "curvature_custom": w(*G2, UND, "deg AS (SELECT v, count(*) AS d FROM und GROUP BY v)") + "SELECT src, dst, (4 - a.d - b.d)::DOUBLE AS curvature FROM edges JOIN deg a ON a.v = src JOIN deg b ON b.v = dst",
    "fiedler_approx": w(*N2, UND, """deg AS (SELECT id, (SELECT count(*) FROM und WHERE v = id AND n <> v) AS d FROM nodes), top AS (SELECT id FROM deg ORDER BY d DESC, id LIMIT 1),
l1 AS (SELECT DISTINCT n AS id FROM und, top WHERE v = top.id AND n <> top.id), l2 AS (SELECT DISTINCT n AS id FROM und JOIN l1 ON v = l1.id WHERE n NOT IN (SELECT id FROM l1 UNION SELECT id FROM top)),
lv AS (SELECT id, 0 AS hop FROM top UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2), rk AS (SELECT id, row_number() OVER (ORDER BY hop, id) AS r FROM lv), s AS (SELECT id FROM rk WHERE r <= (SELECT count(*) FROM lv) // 2),
cut AS (SELECT count(*) AS c FROM und WHERE v <> n AND v IN (SELECT id FROM s) AND n NOT IN (SELECT id FROM s)), vol AS (SELECT sum(d) FILTER (id IN (SELECT id FROM s)) AS a, sum(d) FILTER (id NOT IN (SELECT id FROM s)) AS b, max(d) AS m FROM deg)""") + f"SELECT {R.format('CASE WHEN (SELECT count(*) FROM lv) < (SELECT count(*) FROM nodes) THEN 0 ELSE pow(c / least(a, b), 2) / (2 * m) END', 'value')} FROM cut, vol",
    "velocity": w(*G2) + f"SELECT {R.format('0.1 * sqrt(0.25) * avg(weight)', 'velocity')} FROM edges",
    "estimate_age": w(*N2, UND, HOPS) + f"SELECT source, id, {R.format('CASE WHEN hop > 0 THEN hop / 0.5 ELSE 0 END', 'seconds')} FROM hops",
    "temporal_indicators": w(EV2, HIST, IND) + f"SELECT {R.format('spike', 'tension_spike')}, {R.format('decay', 'decay_exponent')} FROM ind",
    "connectivity_ratio": w(EV2, HIST, IND) + f"SELECT {R.format('avg((node_id IN (SELECT node_id FROM now))::INT)', 'ratio')} FROM bef",
    "phase_classify": "SELECT spike, decay, conn, CASE WHEN rho < 1 THEN CASE WHEN conn >= 0.5 THEN 0 ELSE 1 END ELSE CASE WHEN conn >= 0.5 THEN 2 ELSE 3 END END AS phase FROM (SELECT *, least((CASE WHEN decay < 0 THEN abs(decay) WHEN decay < 0.01 AND mean > 0 THEN mean ELSE 0 END) + spike, 2.0) AS rho FROM (VALUES (0.1::DOUBLE, 2.0::DOUBLE, 0.9::DOUBLE, 0.5::DOUBLE), (0.1, 2.0, 0.2, 0.5), (0.8, -0.5, 0.8, 0.5), (0.8, -0.5, 0.2, 0.5)) t(spike, decay, conn, mean))",
    "temporal_summary": w(EV2, HIST, IND, PHASE) + f"SELECT {R.format('spike', 'tension_spike')}, {R.format('decay', 'decay_exponent')}, {R.format('rho', 'phase_rho')}, {R.format('pi', 'phase_pi')}, CASE WHEN rho < 1 THEN CASE WHEN pi >= 0.5 THEN 0 ELSE 1 END ELSE CASE WHEN pi >= 0.5 THEN 2 ELSE 3 END END AS phase FROM pr",
    "trend": w(EV2, HIST) + f"SELECT node_id, version, {TREND.format('d')} AS trend FROM (SELECT node_id, version, tension - lag(tension) OVER (PARTITION BY node_id ORDER BY version) AS d FROM history) WHERE d IS NOT NULL",
    "tension_lag": w(EV2, HIST) + f"SELECT node_id, version, {R.format('tension', 'tension')}, {R.format('lag(tension) OVER (PARTITION BY node_id ORDER BY version)', 'previous')} FROM history",
    "history_latest": w(EV2, HIST) + f"SELECT node_id, max(version) AS version, {R.format('arg_max(tension, version)', 'tension')} FROM history GROUP BY node_id",
    "history_ring": w(EV2, HIST) + f"SELECT node_id, version, {R.format('tension', 'tension')} FROM history QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY version DESC) <= 3",
    "history_slice": w(EV2, HIST) + f"SELECT node_id, count(*) AS n, {R.format('arg_min(tension, version)', 'oldest')}, {R.format('arg_max(tension, version)', 'newest')} FROM history GROUP BY node_id",
    "tension_spikes": w(EV2, HIST) + f"SELECT node_id, version, {R.format('d', 'delta')} FROM (SELECT node_id, version, abs(tension - lag(tension) OVER (PARTITION BY node_id ORDER BY version)) AS d FROM history) WHERE d > 0.01",
    "delta_nodes": w(EV1) + "SELECT seq, node_id, 0 AS delta_type FROM (SELECT seq, src AS node_id FROM ev UNION ALL SELECT seq, dst FROM ev) QUALIFY seq = min(seq) OVER (PARTITION BY node_id)",
    "delta_edges": w(EV1) + "SELECT seq, src, dst, CASE WHEN row_number() OVER w = 1 THEN 3 ELSE 4 END AS delta_type, round(coalesce(sum(weight) OVER (PARTITION BY src, dst ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS previous FROM ev WINDOW w AS (PARTITION BY src, dst ORDER BY seq)",
    "delta_edges_epochs": w(EV1) + "SELECT seq, src, dst, CASE WHEN row_number() OVER (PARTITION BY (seq - 1) // 500, src, dst ORDER BY seq) = 1 THEN 3 ELSE 4 END AS delta_type FROM ev WHERE seq > 0",
    "delta_trend_changed": w(EV2, HIST, f"t AS (SELECT node_id, version, coalesce({TREND.format('d')}, 0) AS trend FROM (SELECT node_id, version, tension - lag(tension) OVER (PARTITION BY node_id ORDER BY version) AS d FROM history))") + "SELECT node_id, version, trend, last_trend FROM (SELECT *, lag(trend) OVER (PARTITION BY node_id ORDER BY version) AS last_trend FROM t) WHERE last_trend IS NOT NULL AND trend <> last_trend",
    "top_k_tension": w(*T2) + f"SELECT node_id, {R.format('tension', 'tension')} FROM tension ORDER BY tension.tension DESC, node_id LIMIT 10",
    "engine_stats": w(EV1, LAYERS) + "SELECT (SELECT count(*) FROM bn) + (SELECT count(*) FROM oon) AS nodes, (SELECT count(*) FROM base) + (SELECT count(*) FROM over) AS edges, (SELECT count(*) FROM (SELECT id FROM bn UNION SELECT id FROM oon)) AS distinct_nodes, (SELECT count(*) FROM ev WHERE seq % 3 <> 0) AS overlay_events",
    "enum_names": "SELECT * FROM (VALUES ('phase', 0, 'FullRecovery'), ('phase', 1, 'ScarredRecovery'), ('phase', 2, 'ChronicTension'), ('phase', 3, 'StructuralCollapse'), ('phase', 4, 'Phase(4)'), ('region', 0, 'Undetectable'), ('region', 1, 'WeaklyDetectable'), ('region', 2, 'StronglyDetectable'), ('region', 3, 'DetectabilityRegion(3)'), ('region', 4, 'DetectabilityRegion(4)'), ('trend', 0, 'Stable'), ('trend', 1, 'Increasing'), ('trend', 2, 'Decreasing'), ('trend', 3, 'Trend(3)'), ('trend', 4, 'Trend(4)')) t(kind, code, name)",
    "csr_rowptr": w(*N1) + "SELECT row_number() OVER (ORDER BY id) - 1 AS idx, id, (coalesce(sum(out_degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS ptr FROM nodes",
    "csc_colptr": w(*N1) + "SELECT row_number() OVER (ORDER BY id) - 1 AS idx, id, (coalesce(sum(in_degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS ptr FROM nodes",
    "export_json_nodes": w(*N2) + """SELECT '{"id":"' || id || '","type":"' || type || '","degree":' || degree || ',"in_degree":' || in_degree || ',"out_degree":' || out_degree || '}' AS line FROM nodes""",
    "export_json_edges": w(*G2) + """SELECT '{"from":"' || src || '","to":"' || dst || '","weight":' || cnt || '.0,"type":"' || type || '","count":' || cnt || '}' AS line FROM edges""",
    "export_dot_lines": w(*N2) + f"SELECT 0 AS part, 'digraph {{' AS line UNION ALL SELECT 3, '}}' UNION ALL SELECT 1, '  ' || {QUOTE.format('id')} || ' [label=' || {QUOTE.format(chr(40) + 'id || chr(92) || ' + chr(39) + 'n(' + chr(39) + ' || type || ' + chr(39) + ')' + chr(39) + chr(41))} || '];' FROM nodes UNION ALL SELECT 2, '  ' || {QUOTE.format('src')} || ' -> ' || {QUOTE.format('dst')} || ' [label=' || {QUOTE.format(chr(40) + 'type || chr(92) || ' + chr(39) + 'n' + chr(39) + ' || cnt || ' + chr(39) + '.00' + chr(39) + chr(41))} || '];' FROM edges",
    "analyze_full": w(*T2, NODES) + ANALYZE,
    "analyze_node": w(*T2, NODES) + ANALYZE + " WHERE node_id = 'u:7'",
    "analyze_region": w(*T2, f"r AS (SELECT avg(tension) AS mean, max(tension) AS max, count(*) FILTER (tension > 0.05) AS anomaly_count, {SNR.format('tension')} AS snr FROM tension WHERE node_id IN ('u:1', 'u:7', 'u:9', 't:click'))") + f"SELECT {R.format('mean', 'mean')}, {R.format('max', 'max')}, anomaly_count, {R.format('mean', 'aggregated')}, {R.format('snr', 'snr')}, {REGION} AS region FROM r",
    "analyze_incremental": w(*T2) + f"SELECT node_id, {R.format('tension', 'tension')} FROM tension",
    "tension_trade": """WITH ev AS (SELECT l_orderkey * 8 + l_linenumber AS seq, 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst, l_extendedprice AS weight, 'buys' AS type, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT s_suppkey, 's:' || s_suppkey, 'n:' || s_nationkey, 1.0, 'of', TIMESTAMP '1970-01-01' FROM supplier UNION ALL SELECT c_custkey, 'n:' || c_nationkey, 'c:' || c_custkey, 1.0, 'home', TIMESTAMP '1970-01-01' FROM customer),
""" + EDGES + ",\n" + tension() + f"\nSELECT node_id, {R.format('tension', 'tension')} FROM tension",
    "tension_by_type_rollup": w(*T2) + f"SELECT split_part(node_id, ':', 1) AS type, count(*) AS nodes, {R.format('avg(tension)', 'mean')} FROM tension GROUP BY ROLLUP (split_part(node_id, ':', 1))",
    "tension_tumbling": w(EV2) + "SELECT epoch_us(date_trunc('day', ts)) AS start_us, src, dst, round(sum(weight), 4) AS weight, count(*) AS cnt FROM ev GROUP BY date_trunc('day', ts), src, dst",
    "sniper_gap": w(*T2, NODES) + f"SELECT node_id, degree::BIGINT AS degree, round(CASE WHEN stddev_pop(tension) OVER w > 1e-9 THEN (tension - avg(tension) OVER w) / stddev_pop(tension) OVER w ELSE 0 END, 4) + 0.0 AS gap FROM tension JOIN nodes ON id = node_id WINDOW w AS (PARTITION BY degree)",
    "triage_score": w(*T2, NODES, "x AS (SELECT node_id, (tension - min(tension) OVER ()) / (max(tension) OVER () - min(tension) OVER ()) AS a, (degree - min(degree) OVER ()) / (max(degree) OVER () - min(degree) OVER ()) AS b FROM tension JOIN nodes ON id = node_id)") + f"SELECT node_id, {R.format('0.6 * a + 0.4 * b', 'score')} FROM x WHERE 0.6 * a + 0.4 * b >= 0.3",
    "co_occurrence_edges": w(EV2, EDGES, "t AS (SELECT src, dst FROM edges WHERE src LIKE 't:%')") + "SELECT a.src AS a, b.src AS b, count(DISTINCT a.dst) AS shared FROM t a JOIN t b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2",
    "co_occurrence_all": w(EV2, EDGES) + "SELECT a.src AS a, b.src AS b, count(DISTINCT a.dst) AS shared FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2",
    "betti": "WITH RECURSIVE " + w(*N2, UND)[5:].rstrip() + """, rc AS (SELECT id, id AS r FROM nodes UNION SELECT und.n, rc.r FROM rc JOIN und ON und.v = rc.id), lab AS (SELECT id, min(r) AS c FROM rc GROUP BY id)
SELECT count(DISTINCT c)::BIGINT AS beta0, ((SELECT count(*) FROM und WHERE v < n) - count(*) + count(DISTINCT c))::BIGINT AS beta1 FROM lab""",
    "pre_post_windows": w(EV2, "m AS (SELECT seq AS id, src, ts FROM ev WHERE src LIKE 'u:%' AND type = 'error')") + f"SELECT m.id, {R.format('avg(e.weight) FILTER (e.ts < m.ts)', 'pre')}, {R.format('avg(e.weight) FILTER (e.ts > m.ts)', 'post')} FROM m LEFT JOIN ev e ON e.src = m.src AND e.ts >= m.ts - INTERVAL 86400 SECOND AND e.ts <= m.ts + INTERVAL 86400 SECOND GROUP BY m.id",
    "engine_edges": w(EV1, BASE, f"m AS ({MERGE.format('o', 'b')})") + f"SELECT {EDGE} FROM m",
    "export_graphml_lines": w(*G2, NODES) + """SELECT 0 AS part, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || '  <key id="w" for="edge" attr.name="weight" attr.type="double"/>' || chr(10) || '  <graph edgedefault="directed">' AS line
UNION ALL SELECT 1, '    <node id="' || id || '"/>' FROM nodes UNION ALL SELECT 2, '    <edge source="' || src || '" target="' || dst || '"><data key="w">' || cnt || '.0</data></edge>' FROM edges UNION ALL SELECT 3, '  </graph>' || chr(10) || '</graphml>'""",
    "export_gexf_lines": w(*G2, NODES) + """SELECT 0 AS part, '<gexf version="1.3">' || chr(10) || '  <graph defaultedgetype="directed">' || chr(10) || '    <nodes>' AS line UNION ALL SELECT 1, '      <node id="' || id || '" label="' || id || '"/>' FROM nodes
UNION ALL SELECT 2, '    </nodes>' || chr(10) || '    <edges>' UNION ALL SELECT 3, '      <edge source="' || src || '" target="' || dst || '" weight="' || cnt || '.0"/>' FROM edges UNION ALL SELECT 4, '    </edges>' || chr(10) || '  </graph>' || chr(10) || '</gexf>'""",
    "relative_weight": """WITH RECURSIVE e AS (SELECT 'u:' || user_id AS src, event_id AS seq, value AS weight, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
m AS (SELECT src, seq, weight, i, weight AS ema FROM e WHERE i = 1 UNION ALL SELECT e.src, e.seq, e.weight, e.i, 2.0 / 366 * e.weight + (1 - 2.0 / 366) * m.ema FROM m JOIN e ON e.src = m.src AND e.i = m.i + 1)
SELECT src, seq, round(CASE WHEN ema > 0 THEN weight / ema ELSE 0 END, 6) + 0.0 AS relative FROM m""",
    "tension_sessions": w(EV2) + """SELECT epoch_us(min(ts)) AS start_us, src, dst, round(sum(weight), 4) AS weight, count(*) AS cnt FROM (SELECT *, sum(new) OVER (PARTITION BY src, dst ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g
FROM (SELECT *, (ts >= lag(ts) OVER (PARTITION BY src, dst ORDER BY ts) + INTERVAL 6 HOUR)::INT AS new FROM ev)) GROUP BY src, dst, coalesce(g, 0)""",
    "low_degree": w(*T2, NODES) + "SELECT node_id, degree::BIGINT AS degree, degree < 8 AS insufficient, tension > 0.05 AND degree >= 8 AS anomaly FROM tension JOIN nodes ON id = node_id",
    "tension_smoothed": w(*G2, """so AS (SELECT src, sum(weight) AS tot, count(*) AS k FROM edges GROUP BY src), sm AS (SELECT src, dst, CASE WHEN k < 10 THEN k / (k + 2.0) ELSE 1 END * (CASE WHEN tot > 0 THEN weight / tot ELSE 1.0 / k END) + (1 - CASE WHEN k < 10 THEN k / (k + 2.0) ELSE 1 END) / k AS weight FROM edges JOIN so USING (src))""", tension("jsd", "sm")) + f"SELECT node_id, {R.format('tension', 'tension')} FROM tension",
    "tension_counterfactual": w(*G2, """cp AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM edges), ci AS (SELECT dst, sum(weight) AS pull FROM edges GROUP BY dst),
cq AS (SELECT src, p, pull / sum(pull) OVER (PARTITION BY src) AS q FROM cp JOIN ci USING (dst))""") + f"SELECT src AS node_id, {R.format('greatest(sum(0.5 * p * log2(2 * p / (p + q)) + 0.5 * q * log2(2 * q / (p + q))), 0)', 'tension')} FROM cq GROUP BY src",
    "mad_sketch": w(*T2, "med AS (SELECT quantile_disc(tension, 0.5) AS median FROM tension), mad AS (SELECT quantile_disc(abs(tension - median), 0.5) AS mad FROM tension, med)") + f"SELECT {R.format('median', 'median')}, {R.format('mad', 'mad')}, {R.format('median + 3 * mad', 'threshold')} FROM med, mad",
    "divergence_arrays": w(*G2, """dp AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p, 1.0 / count(*) OVER (PARTITION BY src) AS q FROM edges WHERE src LIKE 'u:%'),
dr AS (SELECT *, (p + q) / 2 AS m, sum(p - q) OVER (PARTITION BY src ORDER BY dst) AS run FROM dp)""") + f"SELECT src, {R.format('sum(0.5 * CASE WHEN p > 0 THEN (p + 1e-12) * log2((p + 1e-12) / (m + 1e-12)) ELSE 0 END + 0.5 * (q + 1e-12) * log2((q + 1e-12) / (m + 1e-12)))', 'jsd')}, {R.format('sum(CASE WHEN p > 0 THEN (p + 1e-12) * log2((p + 1e-12) / (q + 1e-12)) ELSE 0 END)', 'kl')}, {R.format('sqrt(sum((sqrt(p) - sqrt(q)) ** 2) / 2)', 'hellinger')}, {R.format('sum(abs(run))', 'wasserstein')} FROM dr GROUP BY src",
    "analyze_curved": w(*T2, NODES, UND, """deg AS (SELECT v, count(*) AS d FROM und GROUP BY v), cv AS (SELECT src, dst, (4 - a.d - b.d)::DOUBLE AS c FROM edges JOIN deg a ON a.v = src JOIN deg b ON b.v = dst), nc AS (SELECT id, avg(c) AS c FROM (SELECT src AS id, c FROM cv UNION ALL SELECT dst, c FROM cv WHERE dst <> src) GROUP BY id),
co AS (SELECT t.node_id, t.tension + coalesce(sum(x.tension * exp(-0.5)), 0) AS o FROM tension t LEFT JOIN und ON v = t.node_id AND n <> v LEFT JOIN tension x ON x.node_id = n GROUP BY t.node_id, t.tension)""") + f"SELECT t.node_id, {R.format('t.tension', 'tension')}, {R.format('nc.c', 'curvature')}, {R.format('o', 'concealment')}, t.tension > 0.05 AND degree >= 8 AS anomaly, {R.format('o', 'part')} FROM tension t JOIN nodes ON nodes.id = t.node_id JOIN nc ON nc.id = t.node_id JOIN co ON co.node_id = t.node_id",
}
