"""Connected components by alternating large-star and small-star steps, each a pair of joins on grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.common import save


def _apart(least: DataFrame) -> DataFrame:
    """Minima dealt anew, so that the join shuffles both of its sides and may split the rows of a hub."""
    return least.repartition(max(1, int(least.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its least neighbour (itself included)."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(_apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(_apart(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns a, b), the component being its least node.

    Null ends and loops are ignored; edges may repeat and point either way; without edges the result is empty. Each round
    is written to the shared folder, so a lost executor costs no earlier round; rounds grow as the logarithm of a chain.
    """
    both = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = save(both, "edges"), None
    while True:
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before:
            break
        before = seen
        if not seen[0]:
            break
        now = save(_small_star(_large_star(now).distinct()).distinct(), "edges")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
