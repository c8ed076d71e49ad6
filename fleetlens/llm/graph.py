"""Connected components of a large graph of many small, star-like groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fleetlens.session import stored


#: Rows up to which a table is kept as one partition: joins and groupings of it then need no exchange.
ONE_TASK = 200_000


def together(df: DataFrame) -> DataFrame:
    """``df`` (stored) in one file if it is small, which is counted; as it is otherwise. Only speed depends on it."""
    return stored(df.coalesce(1)) if df.count() <= ONE_TASK else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; best stored, they are read more than once): root is the least node of its component.

    Alternating large and small stars: every node tells its larger neighbours, then its smaller ones, of the
    least node it knows, until nothing changes (about the logarithm of a component's size in rounds). Each
    step is a grouped minimum, combined before the shuffle, and a join; no component is ever gathered.
    """
    small = edges.count() <= ONE_TASK
    edges = (edges.coalesce(1) if small else edges).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if small else both
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        short = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        seen = Observation()
        edges = (short.coalesce(1) if small else short).where("a != b").distinct()
        edges = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
        now = seen.get
        if now == before:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out = out.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            return out.coalesce(1) if small else out
        before = now
