"""Connected components of a graph given as edges, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, join_hot


def _large_star(edges: DataFrame) -> DataFrame:
    """Each end u of an edge (u > v) is joined to the least of v and all that v has an edge with. An end with very many
    edges is summed before the shuffle, and its answer reaches them by the bounded broadcast of join_hot."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = cut(edges.unionByName(turned).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "near")
    least = near.select("u", F.least("u", "m").alias("m"), "n")
    found = cut(join_hot(turned, least, ["u"], "n", edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
    discard(near)
    return found


def _small_star(edges: DataFrame) -> DataFrame:
    """Each u and its smaller ends are joined to the least of these. After a large star a u has no more of them than it
    had edges, so none gathers many rows."""
    told = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    told = told.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return cut(told.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct(), "small")


def _is_star(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.groupBy("u").agg(F.count("*").alias("n"))
    if ends.where("n > 1").limit(1).count():
        return False
    return not edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of edges (u, v), of any type with an order: nodes that a chain of edges joins get the
    least of them as label. Large and small stars take turns until every node points at its label, which takes a number of
    rounds like the logarithm of the longest chain's length; each is written to the shared folder. Nodes with no edge
    but to themselves don't come back."""
    ends = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    at = cut(ends.distinct(), "edges")
    n = at.count()
    while n and not _is_star(at):
        large = _large_star(at)
        discard(at)
        at = _small_star(large)
        discard(large)
    return at.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
