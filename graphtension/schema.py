"""Fixed schemas; nothing is inferred."""

EVENTS = "seq bigint, src string, dst string, type string, weight double, ts timestamp, metadata map<string,string>"
EDGES = "src string, dst string, weight double, type string, cnt bigint, first_seen timestamp, last_seen timestamp"
NODES = "id string, type string, degree bigint, in_degree bigint, out_degree bigint, first_seen timestamp, last_seen timestamp"
STORED_NODES = "id string, type string, attributes map<string,double>, first_seen timestamp, last_seen timestamp"
HISTORY = "node_id string, version bigint, ts timestamp, tension double"
DELTAS = "type int, version bigint, node_id string, edge_from string, edge_to string, tension double, previous double, weight double"

#: Codes and names, fixed values of the public data model.
TRENDS = {0: "Stable", 1: "Increasing", 2: "Decreasing"}
PHASES = {0: "FullRecovery", 1: "ScarredRecovery", 2: "ChronicTension", 3: "StructuralCollapse"}
REGIONS = {0: "Undetectable", 1: "WeaklyDetectable", 2: "StronglyDetectable"}
DELTA_TYPES = {
    "node_added": 0, "node_updated": 1, "node_removed": 2, "edge_added": 3, "edge_updated": 4, "edge_removed": 5,
    "tension_changed": 6, "anomaly_detected": 7, "anomaly_resolved": 8,
}
