"""Connected components of a graph of edges, in rounds whose number grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.hot_join import join_lookup
from docsift.session import Workspace

MAX_ROUNDS = 200


def _with_least(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """Each node's neighbours, with the least of them and the node itself. The edges of a star's centre may be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    least = workspace.write(least.withColumn("least", F.least("u", "least")), "least")
    return join_lookup(edges, least, ["u"], "inner", workspace)


def _large_star(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """Neighbours larger than a node are linked to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, workspace).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, workspace)
    neighbours = found.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return neighbours.unionByName(found.select("u", F.col("least").alias("v")))


def connected_components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """``node, component`` for every node that has an edge; the component is its smallest node.

    ``edges`` has two columns of nodes, of one comparable type. Alternating large-star and small-star steps (Kiveris et
    al.) turn every component into a star around its smallest node. The least neighbour is found by a partial
    aggregation, so a node with very many neighbours is one row per task there; the join with it is safe for such nodes.
    Each round is a written table, which cuts the lineage.
    """
    u, v = edges.columns
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    edges = workspace.write(edges, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        large = workspace.write(_large_star(edges, workspace).distinct(), "large-star")
        edges = workspace.write(_small_star(large, workspace).where("u <> v").distinct(), "star")
        # Stars do not change any more: the same number of edges and the same sum of their hashes.
        after = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")
        ).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    centers = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centers)
