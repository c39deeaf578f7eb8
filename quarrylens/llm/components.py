"""Connected components of a link table by alternating star contractions.

Each round hangs all larger neighbours of a node on its smallest one (large
star), then all smaller ones (small star), until nothing moves. The rounds are
equi-joins and map-side combined minima, cut by written tables; no link, label
or node list reaches the driver, and a hub is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens import session


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star; edges (a, b) point from larger to smaller."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    large = (
        both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a > b").distinct()
    )
    roots = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(roots, "a")
    return (
        joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(roots.select("a", F.col("m").alias("b")))
        .where("a > b").distinct()
    )


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every linked node.

    Links are undirected; repeats and self-links change nothing; a link with a
    null end is none. A node without links has no row.
    """
    edges = session.cut_lineage(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col("a") > F.col("b")).distinct()
    )
    before = _print(edges)
    while before[0]:
        edges = session.cut_lineage(_stars(edges))
        now = _print(edges)
        if now == before:
            break
        before = now
    return (
        edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    )
