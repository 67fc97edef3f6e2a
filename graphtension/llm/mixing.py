"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtension.llm.common import table, unused, words_in
from graphtension.operators.graph import running
from graphtension.session import materialize

#: The hash of a document falls into one of so many bins.
BINS = 4096


def hash_bin(key: Column, seed: str) -> Column:
    """0 .. BINS - 1, uniform, from the seed and the key; the same on every run."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("bigint") % BINS).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source throughout.

    Sources in code point order, null last, take ``weights`` in turn. Targets share the total in these proportions;
    none goes above ``most`` times its source's size, and what that leaves is shared among the others. With sources
    in the order of limit over weight, those before the first whose limit isn't reached are at their limits. Places
    and sums in an order come from range partitions, so sources may be many.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    at = F.struct(F.col("source").isNull().alias("last"), F.col("source").alias("name"))
    s = running(sizes.withColumn("at", at), "at", {"i": F.lit(1).cast("bigint")})
    s = s.withColumn("w", F.get(w, (F.col("i") % len(weights)).cast("int"))).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    s = s.select("source", "source_size", "w", "limit", F.struct((F.col("limit") / F.col("w")).alias("r"), "at").alias("by"))
    s = running(s, "by", {"limits": F.col("limit"), "ws": F.col("w")})
    s = materialize(s, "ordered")
    words, ws = s.agg(F.sum("source_size"), F.sum("w")).first()
    if words is None:
        return s.select("source", "source_size", F.lit(0.0).alias("target"))
    s = s.withColumn("level", (F.lit(float(words)) - F.col("limits")) / (F.lit(ws) - F.col("ws")))
    found = s.filter(F.col("level") <= F.col("by.r")).agg(F.min(F.struct("by.r", "level")).alias("x")).select("x.level").first().level
    return s.select("source", "source_size", (F.col("limit") if found is None else F.least("limit", F.lit(found) * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs`` (doc_id, text, source).

    A source's rate is target over size. Each document is taken floor(rate) times, and drawn once more if its hash
    lies below an edge. A plain draw's edge is the fraction itself, which few or uneven documents miss by far; here
    the edge is the bin at which the source's words, in the order of the hash, come closest to fraction times its
    size. That is the plain draw, corrected: documents whose hash lies between the two edges change sides.

    Nulls and empties: a null text has size 0; null sources are one source, the last; null ids hash alike. Repeated
    rows are taken alike. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    sized = materialize(docs.select("doc_id", "source", words_in("text").alias("size"), hash_bin(F.col("doc_id"), seed).alias("bin")), "sizes")
    plan = mixing_plan(sized, weights, most)
    joined = sized.join(plan, sized.source.eqNullSafe(plan.p_source))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + (F.col("bin") < F.col("cut")).cast("int")).alias("copies"))


def mixing_plan(sized: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(p_source, source_size, target, base, cut) from rows (source, size, bin); summed by source and bin first."""
    bins = materialize(sized.groupBy("source", "bin").agg(F.sum("size").alias("size")), "bins")
    targets = materialize(source_targets(bins.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).otherwise(0.0)
    targets = targets.withColumn("base", F.floor(rate).cast("int")).withColumn("goal", (rate - F.floor(rate)) * F.col("source_size"))
    t = targets.withColumnRenamed("source", "p_source")
    run = Window.partitionBy("source").orderBy("bin")
    c = bins.select("source", (F.col("bin") + 1).alias("cut"), F.sum("size").over(run).alias("words"))
    c = c.join(t, c.source.eqNullSafe(t.p_source)).select("p_source", "cut", F.abs(F.col("words") - F.col("goal")).alias("off"))
    none = t.select("p_source", F.lit(0).alias("cut"), F.abs(F.col("goal")).alias("off"))
    best = c.unionByName(none).groupBy(F.col("p_source").alias("b_source")).agg(F.min(F.struct("off", "cut")).alias("x"))
    return t.join(best, t.p_source.eqNullSafe(best.b_source)).select("p_source", "source_size", "target", "base", F.col("x.cut").alias("cut"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def resample(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as mix() takes it, with all its columns, whatever their names.

    A null text has size 0 and goes with its source's rate; null sources are one source. Repeated rows stay alike; an
    empty table gives no rows.
    """
    size, at, base, cut, source, copy = unused(docs, "size", "bin", "base", "cut", "p_source", "copy")
    sized = docs.withColumn(size, words_in("text")).withColumn(at, hash_bin(F.col("doc_id"), seed))
    small = materialize(sized.select("source", F.col(size).alias("size"), F.col(at).alias("bin")), "sizes")
    plan = mixing_plan(small, weights, most).select(F.col("p_source").alias(source), F.col("base").alias(base), F.col("cut").alias(cut))
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col(source)))
    times = F.col(base) + (F.col(at) < F.col(cut)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 4096 AS bin FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS lim FROM s),
r AS (SELECT *, lim / w AS r FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(lim, (SELECT arg_min(level, r) FROM l WHERE level <= r) * w) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base, CASE WHEN source_size > 0 THEN (target / source_size - floor(target / source_size)) * source_size ELSE 0 END AS goal FROM t),
b AS (SELECT source, bin + 1 AS cut, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS words FROM d GROUP BY source, bin),
c AS (SELECT g.source, b.cut, abs(b.words - g.goal) AS off FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source UNION ALL SELECT source, 0, abs(goal) FROM g),
k AS (SELECT source, (min({'off': off, 'cut': cut})).cut AS cut FROM c GROUP BY source)
SELECT d.doc_id, d.size, g.source_size, g.target, (d.size * (g.base + (d.bin < k.cut)::INT))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
