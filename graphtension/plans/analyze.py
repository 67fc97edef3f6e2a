"""Whole analyses: of a graph, of one node, of a region."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtension.config import Config
from graphtension.errors import NodeNotFound
from graphtension.operators import stats, temporal
from graphtension.operators.curvature import curvature_of, node_curvature
from graphtension.operators.graph import nodes_of, undirected
from graphtension.operators.hops import concealment, fiedler_approx, velocity
from graphtension.operators.spectral import fiedler_value
from graphtension.operators.tension import DIVERGENCES, tension, tension_arrays
from graphtension.session import bytes_in, discard, materialize


@dataclass
class Results:
    """Lazy parts of an analysis; nothing runs before a part is used."""

    tensions: DataFrame
    stats: DataFrame
    detectability: DataFrame
    curvature: DataFrame | None = None
    temporal: DataFrame | None = None

    topology: DataFrame | None = None

    def settled(self) -> Results:
        """All parts computed, as tables in the shared folder that outlive the snapshot and executors."""
        if self.written:
            return self
        parts = {c: materialize(df, c) if (df := getattr(self, c)) is not None else None for c in ("tensions", "stats", "detectability", "curvature", "temporal", "topology")}
        return Results(**parts)

    def _tables(self) -> list[DataFrame]:
        return [df for df in (self.tensions, self.stats, self.detectability, self.curvature, self.temporal, self.topology) if getattr(df, "_written", None)]

    @property
    def written(self) -> bool:
        return getattr(self.tensions, "_written", None) is not None

    def size(self) -> int:
        """Bytes of what is written."""
        return sum(bytes_in(df.sparkSession, df._written) for df in self._tables())

    def unpersist(self) -> None:
        """Delete what settled() wrote."""
        for df in self._tables():
            discard(df)

    @property
    def anomalies(self) -> DataFrame:
        return self.tensions.filter("anomaly")


def tension_of(edges: DataFrame, divergence) -> DataFrame:
    """A closed form by name or as a Column function; a class with compute(p, q) goes the array way."""
    if not isinstance(divergence, str) and hasattr(divergence, "compute"):
        return tension_arrays(edges, divergence.compute)
    if isinstance(divergence, str) and not DIVERGENCES[divergence][1]:
        import warnings

        warnings.warn(f"divergence {divergence} is not bounded: thresholds need care", stacklevel=2)
    return tension(edges, divergence)


def _scored(edges: DataFrame, t: DataFrame, config: Config, curv: DataFrame | None, ids: DataFrame, loops: int) -> DataFrame:
    deg = nodes_of(edges).select(F.col("id").alias("node_id"), "degree")
    out = t.join(deg, "node_id")
    out = out.join(node_curvature(curv, loops), "node_id", "left").fillna(0.0, ["curvature"]) if curv is not None else out.withColumn("curvature", F.lit(0.0))
    if config.concealment_lambda > 0 or config.concealment_hops > 0:
        out = out.join(concealment(edges, tension_of(edges, config.divergence), ids, config.concealment_lambda, config.concealment_hops), "node_id", "left").fillna(0.0, ["concealment"])
    else:
        out = out.withColumn("concealment", F.lit(0.0))
    flag = stats.is_anomaly(F.col("tension"), F.col("node_id"), config.threshold, config.calibrator, config.threshold_func)
    if config.min_degree:
        flag = flag & (F.col("degree") >= config.min_degree)
    return out.select(
        "node_id", "tension", "degree", "curvature", flag.alias("anomaly"), stats.confidence(F.col("degree")).alias("confidence"), "concealment",
        F.lit(0).alias("trend"), stats.components(F.col("tension"), F.col("curvature"), F.col("concealment")).alias("components"),
    )


def _curvature(edges: DataFrame, config: Config) -> DataFrame | None:
    return curvature_of(edges, config.curvature_func, config.curvature_alpha) if config.curvature_alpha > 0 else None


def analyze(edges: DataFrame, config: Config | None = None, previous: DataFrame | None = None, dt: float = 0.0, spectral: bool = False) -> Results:
    """All nodes. ``previous`` (node_id, tension), taken ``dt`` seconds before, adds trends and the temporal block,
    with the bound on algebraic connectivity or (``spectral``) its value. ``config.topology`` adds its frame."""
    config = config or Config()
    t = tension_of(edges, config.divergence)
    curv = _curvature(edges, config)
    ids = t.select(F.col("node_id").alias("id"))
    if config.calibrator is not None and not config.calibrator.warm:
        config.calibrator.fit(t, "tension", "node_id")
    rows = _scored(edges, t, config, curv, ids, loops=1)
    block = None
    if previous is not None:
        rows = rows.drop("trend").join(previous.select("node_id", F.col("tension").alias("_p")), "node_id", "left").withColumn("trend", F.when(F.col("_p").isNull(), 0).otherwise(temporal.trend(F.col("tension"), F.col("_p")))).drop("_p")
        block = temporal_block(edges, t, previous, dt, config, spectral)
    shape = config.topology(nodes_of(edges), edges) if config.topology is not None else None
    return Results(rows, stats.result_stats(rows), stats.detectability(rows, config.detectability_alpha), curv, block, shape)


def temporal_block(edges: DataFrame, now: DataFrame, previous: DataFrame, dt: float, config: Config, spectral: bool = False, curvature: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row of indicators; ``curvature`` (now, before) feeds the curvature shock. No velocity under three nodes."""
    ind = temporal.indicators(now, previous, dt, *(curvature or ()))
    ratio = temporal.connectivity(now, previous)
    length = edges.agg(F.coalesce(F.avg("weight"), F.lit(1.0)).alias("length"))
    lam = (fiedler_value(edges) if spectral else fiedler_approx(edges)).withColumnRenamed("value", "lam")
    out = ind.join(ratio).join(length).join(lam).join(now.agg(F.count(F.lit(1)).alias("n")))
    out = out.withColumn("phase_rho", temporal.rho(F.col("tension_spike"), F.col("decay_exponent"), F.col("mean"))).withColumn("phase_pi", temporal.pi(F.col("ratio")))
    return out.select(
        "tension_spike", "decay_exponent", "curvature_shock", temporal.phase(F.col("phase_rho"), F.col("phase_pi")).alias("phase"), "phase_rho", "phase_pi",
        F.when(F.col("n") >= 3, velocity(F.lit(config.diffusivity_alpha), F.col("lam"), F.col("length"))).otherwise(0.0).alias("velocity"),
    )


def near(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges that the tension of ``ids`` depends on: all out-edges of their neighbours and their own."""
    nb = undirected(edges).join(ids.select(F.col("id").alias("v")), "v", "left_semi").select(F.col("n").alias("src")).union(ids.select("id")).distinct()
    return edges.join(nb, "src", "left_semi")


def analyze_node(edges: DataFrame, node: str, config: Config | None = None) -> DataFrame:
    """One row for one node, from its surroundings only."""
    ids = edges.sparkSession.createDataFrame([(node,)], "id string")
    if edges.filter((F.col("src") == node) | (F.col("dst") == node)).isEmpty():
        raise NodeNotFound(node)
    return score_nodes(edges, ids, config).drop("trend")


def score_nodes(edges: DataFrame, ids: DataFrame, config: Config | None = None) -> DataFrame:
    config = config or Config()
    part = near(edges, ids)
    want = ids.select(F.col("id").alias("node_id")).distinct()
    t = tension_of(part, config.divergence).join(want, "node_id", "left_semi")
    curv = _curvature(edges, config)
    if curv is not None:
        touch = curv.join(want.withColumnRenamed("node_id", "src"), "src", "left_semi")
        curv = touch.unionByName(curv.join(want.withColumnRenamed("node_id", "dst"), "dst", "left_semi").join(want.withColumnRenamed("node_id", "src"), "src", "left_anti").select("src", "dst", "curvature"))
    return _scored(edges, t, config, curv, ids, loops=2)


def region_rows(edges: DataFrame, ids: list[str], config: Config | None = None) -> DataFrame:
    """A scored row for each given id that exists, in order (``pos``), duplicates kept."""
    given = edges.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    scored = score_nodes(edges, given.select("id").distinct(), config)
    return scored.join(given.withColumnRenamed("id", "node_id"), "node_id")


def analyze_region(edges: DataFrame, ids: list[str], config: Config | None = None) -> DataFrame:
    """One row: mean, max (floored at 0), anomalies, the aggregate, detectability and concealment pressure."""
    config = config or Config()
    rows = region_rows(edges, ids, config)
    agg = stats.AGGREGATIONS[config.aggregation] if isinstance(config.aggregation, str) else config.aggregation
    limit = stats.yharim_limit(config.detectability_alpha)
    out = rows.agg(
        F.coalesce(F.avg("tension"), F.lit(0.0)).alias("mean"), F.greatest(F.coalesce(F.max("tension"), F.lit(0.0)), F.lit(0.0)).alias("max"), F.coalesce(F.sum(F.col("anomaly").cast("bigint")), F.lit(0)).alias("anomaly_count"),
        agg(F.col("tension")).alias("aggregated"), F.coalesce(stats.snr(), F.lit(0.0)).alias("snr"), F.coalesce(F.sum("concealment"), F.lit(0.0)).alias("omega"),
    )
    out = out.withColumn("region", stats.region_code(F.col("snr"), limit))
    return out.withColumn("cps", stats.cps(F.col("mean"), F.col("omega"), F.col("region"))).withColumn("threshold", F.lit(limit))


def analyze_incremental(edges: DataFrame, known: DataFrame, touched: DataFrame, divergence="jsd") -> DataFrame:
    """Tensions after a change: the touched ids (id) and their neighbours anew, the rest from ``known``."""
    dirty = undirected(edges).join(touched.select(F.col("id").alias("v")), "v", "left_semi").select(F.col("n").alias("id")).union(touched.select("id")).distinct()
    two = undirected(edges).join(dirty.select(F.col("id").alias("v")), "v", "left_semi").select(F.col("n").alias("id")).union(dirty).distinct()
    fresh = tension_of(near(edges, two), divergence).join(two.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return fresh.unionByName(known.select("node_id", "tension").join(fresh, "node_id", "left_anti"))
