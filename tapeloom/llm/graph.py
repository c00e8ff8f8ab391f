"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.text import staged


def _are_stars(edges: DataFrame) -> bool:
    """Whether each greater node of the links has one link and is no other's lesser node."""
    nodes = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
    return nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter(
        "up > 1 or up = 1 and down = 1").isEmpty()


def _both(one: list, two: list) -> Column:
    return F.explode(F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in (one, two)])).alias("x")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link a node's neighbours to the least node among them and itself.

    Large: the greater neighbours; small: the lesser ones and the node. The least
    neighbour comes from a map-side aggregate and an inner join, which adaptive
    execution splits where a node has very many links.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    both = edges.select(_both([u, v], [v, u])).select("x.*") if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
    if large:
        return joined.filter("v > u").select(v.alias("u"), m.alias("v")).distinct()
    return joined.select(_both([v, m], [u, m])).select("x.*").filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v): each node of the links (two long columns) that is not the least of its
    component, with the least node. Alternates large and small stars until all links are
    stars around the least nodes; rounds grow with the logarithm of the longest chain.
    Each round is written to the shared folder.
    """
    a, b = links.columns
    edges = staged(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not _are_stars(edges):
        edges = staged(_star(_star(edges, True), False), "stars")
    return edges
