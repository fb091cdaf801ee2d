"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from eventloom.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """The component of every linked node: rows ``(node, component)``, the component being its least node.

    ``links`` has a row for each undirected link between the bigint nodes in columns ``a`` and ``b``. Each round joins
    every node with its least neighbour, first over the larger neighbours, then over the smaller ones; a hub with many
    neighbours is reduced by a map-side minimum and its rows are spread by the join, never gathered. Rounds end when
    the links no longer change; each is cut with a checkpoint.

    Nulls: a link with a null end is ignored. Self-links, repeated and reversed links change nothing. A node that only
    has self-links, and an empty input, give no row. Extra columns are ignored.
    """
    edges = (
        links.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        seen = Observation()
        edges = cut(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        now = seen.get
        if now == state or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state, edges = now, _small_star(_large_star(edges))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
