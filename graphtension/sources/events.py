"""Event sources: validation, normalisation, and the canonical event graphs over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtension.errors import InvalidEvent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; times without a zone become instants of the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def event_error() -> Column:
    """The first rule that an event breaks, or null: source, then target, then weight. NaN weights are refused too."""
    return (
        F.when(F.coalesce(F.col("src"), F.lit("")) == "", "empty source")
        .when(F.coalesce(F.col("dst"), F.lit("")) == "", "empty target")
        .when(F.isnan("weight") | (F.col("weight") < 0), "negative weight")
    )


def validate(events: DataFrame) -> DataFrame:
    return events.withColumn("error", event_error())


def normalize(events: DataFrame, now: Column | None = None, default: float | None = 1.0) -> DataFrame:
    """Weight 0 (or none) becomes ``default``, unless that is None; a missing time becomes ``now``."""
    if default is not None:
        w = F.coalesce(F.col("weight"), F.lit(0.0))
        events = events.withColumn("weight", F.when(w == 0, float(default)).otherwise(w))
    return events.withColumn("ts", F.coalesce("ts", now if now is not None else F.current_timestamp()))


def checked_batch(events: DataFrame) -> DataFrame:
    """All or nothing: any invalid event fails the batch."""
    first = validate(events).filter("error is not null").select("error").limit(1).collect()
    if first:
        raise InvalidEvent(first[0].error)
    return events


def project(events: DataFrame, weight_func=None) -> DataFrame:
    """Apply a user's weight projection after normalisation; the outcome is not validated again."""
    return events if weight_func is None else events.withColumn("weight", weight_func(F.col("weight"), F.col("type")))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: each event links the previous event's user to its own.

    The global lag is taken within days; a day's first event takes the last user of the day with events before,
    from a table with one row for each day. So no task orders all events.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("day", F.to_date("ts"))
    at = F.struct("ts", "event_id")
    days = e.groupBy("day").agg(F.max_by("user_id", at).alias("u")).withColumn("before", F.lag("u").over(Window.orderBy("day"))).select("day", "before")
    e = e.withColumn("p", F.lag("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id")))
    e = e.join(days, "day").withColumn("p", F.coalesce("p", "before")).filter("p is not null")
    u = lambda c: F.concat(F.lit("u:"), F.col(c).cast("string"))
    return e.select(F.col("event_id").alias("seq"), u("p").alias("src"), u("user_id").alias("dst"), F.col("event_type").alias("type"), F.col("value").alias("weight"), "ts")


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2: users and event types, linked both ways."""
    e = table(spark, sf_dir, "events")
    u, t = F.concat(F.lit("u:"), F.col("user_id").cast("string")), F.concat(F.lit("t:"), F.col("event_type"))
    ends = F.explode(F.array(F.struct(u.alias("src"), t.alias("dst")), F.struct(t.alias("src"), u.alias("dst"))))
    return e.select(F.col("event_id").alias("seq"), ends.alias("x"), F.col("event_type").alias("type"), F.col("value").alias("weight"), "ts").select("seq", "x.src", "x.dst", "type", "weight", "ts")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3: customer to supplier by order lines, supplier to nation, nation to customer."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    epoch = F.lit("1970-01-01").cast("timestamp")
    buys = li.join(o, li.l_orderkey == o.o_orderkey).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), key("c:", "o_custkey").alias("src"), key("s:", "l_suppkey").alias("dst"), F.lit("buys").alias("type"), F.col("l_extendedprice").alias("weight"), F.col("o_orderdate").alias("ts"))
    of = s.select(F.col("s_suppkey").cast("bigint").alias("seq"), key("s:", "s_suppkey").alias("src"), key("n:", "s_nationkey").alias("dst"), F.lit("of").alias("type"), F.lit(1.0).alias("weight"), epoch.alias("ts"))
    home = c.select(F.col("c_custkey").cast("bigint").alias("seq"), key("n:", "c_nationkey").alias("src"), key("c:", "c_custkey").alias("dst"), F.lit("home").alias("type"), F.lit(1.0).alias("weight"), epoch.alias("ts"))
    return buys.unionByName(of).unionByName(home)
