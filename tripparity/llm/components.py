"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripparity.llm.common import materialize

MAX_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(rows: DataFrame, name: str) -> DataFrame:
    """Joins each row (u, v) with the least of u and its listed neighbours.

    The minima are written first, so both sides of the join are plain exchanges and a vertex that
    owns a large share of the edges is split by adaptive execution.
    """
    least = materialize(rows.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), name)
    return rows.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable vertex of every vertex that has an edge.

    ``edges`` has long columns u, v (self loops and repeats allowed). Returns (node, root), root
    the smallest node of the component in signed order. Alternates large-star and small-star
    contraction until the edge table is a forest of stars; the number of rounds is logarithmic and
    each round writes its edges, so nothing is kept on executors.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "cc-edges")
    before = None
    for _ in range(MAX_ROUNDS):
        large = _star(_both_ways(edges), "cc-large-min").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "cc-large")
        # Every large-star edge runs from a vertex to a smaller one.
        small = _star(large, "cc-small-min")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "cc-small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError("connected components did not settle")
