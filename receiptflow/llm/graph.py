"""Connected components of an edge table by alternating large and small stars.

Each round joins every node to the least of its neighbours; the table is
written to the shared folder after a round, so its lineage stays short and
nothing but three numbers reaches the driver.  Rounds go with the logarithm of
the longest chain.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(a, b) with b < a: a's new parent."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("v < u").select(F.explode(F.array(
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least reachable node) of every node in the edges.
    Null ends and loops link nothing; an empty table gives no rows."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = materialize(now, "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(
            F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = materialize(_star(_star(now, True), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b"), F.col("b")).distinct())
