"""Building, merging and reading graphs kept as edge and node DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtension.schema import STORED_NODES


@dataclass(frozen=True)
class GraphData:
    """A graph as bases and stores hold it: edges, nodes with types and attributes (isolated ones too), metadata."""

    edges: DataFrame
    nodes: DataFrame | None = None
    metadata: dict = field(default_factory=dict)


def as_data(given: GraphData | DataFrame) -> GraphData:
    return given if isinstance(given, GraphData) else GraphData(given)


def _stored(nodes: DataFrame) -> DataFrame:
    """Columns that stored nodes lack, as nulls."""
    kinds = dict(x.split(" ", 1) for x in STORED_NODES.split(", "))
    return nodes.select(*[(F.col(c) if c in nodes.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def stored_nodes(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """All nodes of a graph as they are kept: those of the edges and the given ones; a given type and attributes stay,
    times are the widest."""
    mine = _stored(nodes_of(edges))
    if nodes is None:
        return mine
    both = mine.unionByName(_stored(nodes)).withColumn("given", F.when(F.col("type") != "", F.col("type")))
    return both.groupBy("id").agg(F.coalesce(F.max("given"), F.lit("")).alias("type"), F.first("attributes", True).alias("attributes"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def isolated(edges: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(_ends(edges).select("id").distinct(), "id", "left_anti")


def with_stored(nodes: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Derived nodes with attributes; a type that isn't derived, and nodes without edges, come from the stored ones."""
    if stored is None:
        return nodes.withColumn("attributes", F.lit(None).cast("map<string,double>"))
    s = _stored(stored).select("id", F.col("type").alias("_t"), "attributes", F.col("first_seen").alias("_a"), F.col("last_seen").alias("_b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return nodes.join(s, "id", "full_outer").select(
        "id", F.coalesce(F.when(F.col("type") != "", F.col("type")), F.col("_t"), F.lit("")).alias("type"), zero("degree"), zero("in_degree"), zero("out_degree"),
        F.least("first_seen", "_a").alias("first_seen"), F.greatest("last_seen", "_b").alias("last_seen"), "attributes",
    )


def edges_of(events: DataFrame) -> DataFrame:
    """Fold events into one row per (src, dst); the type is that of the first event. Commutes with event order."""
    return events.groupBy("src", "dst").agg(
        F.sum("weight").alias("weight"), F.min_by("type", "seq").alias("type"), F.count(F.lit(1)).alias("cnt"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


def _ends(df: DataFrame, *keep: str) -> DataFrame:
    """Two rows per row, one for each end; a self-loop keeps both."""
    return df.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"), *keep).select("x.id", "x.o", "x.i", *keep)


def nodes_of(edges: DataFrame, node_type: Column | None = None) -> DataFrame:
    """Nodes with degrees that are always derived from edges, never stored; first and last touch."""
    n = _ends(edges, "first_seen", "last_seen").groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return n.select("id", (node_type if node_type is not None else F.lit("")).alias("type"), (F.col("out_degree") + F.col("in_degree")).alias("degree"), "in_degree", "out_degree", "first_seen", "last_seen")


def prefix_type(col: str = "id") -> Column:
    """The usual node type: what stands before the first colon."""
    return F.split(F.col(col), ":")[0]


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (v, n) with n a neighbour of v either way; a self-loop makes v its own neighbour."""
    pair = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("n")), F.struct(F.col("dst").alias("v"), F.col("src").alias("n"))))
    return edges.select(pair.alias("x")).select("x.v", "x.n").distinct()


def out_neighbors(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("src") == node).select(F.col("dst").alias("id"))


def in_neighbors(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("dst") == node).select(F.col("src").alias("id"))


#: Members of a group that are paired with others at once.
BLOCK = 512


def co_occurrence(edges: DataFrame) -> DataFrame:
    """(a, b, shared) for all pairs of sources a < b that share targets, and how many.

    Targets are paired once for each two groups of sources with equal target sets (told by two 64-bit hashes and the
    number), so a target that many alike sources share needs no pair expansion. Then blocks of members meet, each two
    once, so that every pair is made once and the pairs of one large group are dealt to many tasks.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    group = e.groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("dst")).alias("f1"), F.bit_xor(F.xxhash64("dst", F.lit(1))).alias("f2"))
    first = group.groupBy("k", "f1", "f2").agg(F.min("src").alias("g"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    member = group.join(first, ["k", "f1", "f2"]).select("src", "g", F.pmod(F.xxhash64("src", F.lit(2)), "n").cast("int").alias("i"))
    block = member.groupBy("g", "i").agg(F.collect_list("src").alias("vs"))
    t = e.join(first.select(F.col("g").alias("src"), "n"), "src")
    pairs = t.select(F.col("src").alias("g"), F.col("n").alias("gn"), "dst").join(t.select(F.col("src").alias("h"), F.col("n").alias("hn"), "dst"), "dst").filter("g <= h").groupBy("g", "h", "gn", "hn").agg(F.count(F.lit(1)).alias("shared"))
    # within a group, block i meets those up to half the circle ahead: as many for each block
    ahead = F.expr("CASE WHEN g < h THEN sequence(0, hn - 1) ELSE transform(sequence(0, (gn - IF(2 * i < gn, 0, 1)) DIV 2), d -> CAST(pmod(i + d, gn) AS int)) END")
    two = pairs.withColumn("i", F.explode(F.expr("sequence(0, gn - 1)"))).withColumn("j", F.explode(ahead))
    two = two.join(block.withColumnRenamed("vs", "us"), ["g", "i"]).select("us", "shared", "h", "j", ((F.col("g") == F.col("h")) & (F.col("i") == F.col("j"))).alias("own"))
    # by number, since AQE would put blocks of few bytes and many pairs together
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    two = two.repartition(parts, "h", "j").join(block.select(F.col("g").alias("h"), F.col("i").alias("j"), "vs"), ["h", "j"])
    each = two.select(F.explode("us").alias("u"), "vs", "shared", "own").select("u", F.explode("vs").alias("v"), "shared", "own").filter("NOT own OR u < v")
    return each.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "shared")


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """Rows (id, type, last_seen, seq): the last write's type wins, even if empty; last_seen moves only if given."""
    return nodes.groupBy("id").agg(F.max_by(F.coalesce("type", F.lit("")), "seq").alias("type"), F.max_by("last_seen", F.when(F.col("last_seen").isNotNull(), F.col("seq"))).alias("last_seen"))


def merge_edges(base: DataFrame, overlay: DataFrame, type_from: str = "overlay") -> DataFrame:
    """Two layers of edges as one. A read-time view takes the overlay's type, a compaction the base's."""
    b, o = base.alias("b"), overlay.alias("o")
    first, then = ("o", "b") if type_from == "overlay" else ("b", "o")
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0).cast(t))
    return b.join(o, (F.col("b.src") == F.col("o.src")) & (F.col("b.dst") == F.col("o.dst")), "full_outer").select(
        F.coalesce("b.src", "o.src").alias("src"), F.coalesce("b.dst", "o.dst").alias("dst"), (zero("b.weight", "double") + zero("o.weight", "double")).alias("weight"),
        F.coalesce(f"{first}.type", f"{then}.type").alias("type"), (zero("b.cnt", "bigint") + zero("o.cnt", "bigint")).alias("cnt"),
        F.least("b.first_seen", "o.first_seen").alias("first_seen"), F.greatest("b.last_seen", "o.last_seen").alias("last_seen"),
    )


def merge_nodes(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """The overlay's row wins as a whole, degree included."""
    return overlay.unionByName(base.join(overlay, "id", "left_anti"))


def compact_stats(base_nodes: DataFrame, base_edges: DataFrame, over_nodes: DataFrame, over_edges: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    before = one(over_nodes.select(F.lit(1).alias("x")).unionByName(over_edges.select(F.lit(1).alias("x"))), "overlay_before")
    return (
        one(base_nodes.join(over_nodes, "id", "left_semi"), "nodes_merged")
        .join(one(base_edges.join(over_edges, ["src", "dst"], "left_semi"), "edges_merged"))
        .join(before).withColumn("overlay_after", F.lit(0).cast("bigint"))
    )


def counts(edges: DataFrame) -> DataFrame:
    n = _ends(edges).agg(F.count_distinct("id").alias("nodes"))
    return n.join(edges.agg(F.count(F.lit(1)).alias("edges")))


def csr(edges: DataFrame, by: str = "src") -> DataFrame:
    """Compressed rows over sorted ids: (idx, id, ptr, cols); ``by='dst'`` gives columns.

    Positions come from a range sort and one offset per partition, so no task sees all ids.
    """
    other = "dst" if by == "src" else "src"
    ids = _ends(edges).select("id").distinct()
    adj = edges.groupBy(F.col(by).alias("id")).agg(F.sort_array(F.collect_list(other)).alias("cols"))
    rows = ids.join(adj, "id", "left").withColumn("cols", F.coalesce("cols", F.array().cast("array<string>")))
    return running(rows.withColumn("len", F.size("cols").cast("bigint")), "id", {"idx": F.lit(1).cast("bigint"), "ptr": F.col("len")}).select("idx", "id", "ptr", "cols")


def running(df: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums in a total order: within range partitions, plus one offset row per partition.

    The sorted rows are written first, so both uses see the same partitions.
    """
    from pyspark.sql import Window

    from graphtension.session import materialize

    part = df
    for name, col in sums.items():
        part = part.withColumn(name, col)
    held = materialize(part.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()), "ordered")
    offs = held.groupBy("_p").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    over = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = offs.select("_p", *[F.coalesce(F.sum(f"_{n}").over(over), F.lit(0)).alias(f"_{n}") for n in sums])
    inner = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = held.select("*", *[F.coalesce(F.sum(n).over(inner), F.lit(0)).alias(f"_in_{n}") for n in sums]).join(offs, "_p")
    return out.select(*[c for c in df.columns], *[(F.col(f"_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums])
