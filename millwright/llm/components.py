"""Connected components of an edge table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.store import Cut


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for every vertex of ``edges`` (a, b) the smallest vertex of its component.

    Each step replaces the edges by stars around smaller vertices, until none changes; it takes a few steps, each a
    pre-aggregated minimum and a join, and no neighbourhood is ever gathered. Steps are written to the
    shared folder. Null and equal ends are left out.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = Cut(start, "edges")
    size = now.df.count()
    if not size:
        return now.df.select(F.col("a").alias("v"), F.col("b").alias("label"))
    digest = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = Cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now.drop()
        now = after
        # done when every vertex has one edge, to a vertex without a smaller neighbour
        state = now.df.agg(F.count("*").alias("n"), F.count_distinct("a").alias("v"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if state == digest and state["n"] == state["v"]:
            return now.df.select(F.col("a").alias("v"), F.col("b").alias("label"))
        digest = state
