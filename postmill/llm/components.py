"""Connected components of a graph whose links are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import shared_dir


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node in links (a, b: long); component is the smallest node reachable.

    Alternates large-star and small-star steps until every link points from a node to the smallest of its
    component. No neighbourhood is gathered: a step is a minimum per node and a join back, in which Spark
    splits skewed nodes. Each step's links are checkpointed. Links of a node to itself and nulls are dropped;
    no links give no rows.
    """
    shared_dir(links.sparkSession)
    both = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        sides = both(edges)
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = small.checkpoint()
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError("connected_components: no end after max_rounds rounds")
