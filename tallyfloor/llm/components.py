"""Connected components of a graph given by links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import keyed_join, settle


def _minimum(pairs: DataFrame) -> DataFrame:
    """For each node u of pairs (u, v): the smallest of u and all v, and how many rows u has."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count(F.lit(1)).alias("n"))


def _relabel(pairs: DataFrame, keep) -> DataFrame:
    """Links each v of u, where ``keep`` holds, to the smallest neighbour of u, and u to it."""
    pairs = settle(pairs)
    low = settle(_minimum(pairs))
    joined = keyed_join(pairs, low, "u", "n", pairs.count()).where(keep).select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = low.select("u", F.col("low").alias("v"))
    return joined.unionByName(own).where("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    """Number of links and a digest of the set of them."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame, node: str, root: str) -> DataFrame:
    """``node``, ``root`` for every node that a link (a, b) names: the root is the component's smallest node.

    Alternates two steps until nothing changes, each of which keeps components and only ever links to smaller
    nodes: every larger neighbour of a node is linked to the node's smallest neighbour; every smaller neighbour is linked to the smallest one.
    The number of rounds grows with the logarithm of the longest path. A node with very many links is handled by
    partial minima and a broadcast of the few such nodes; each round is a written table."""
    links = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(_relabel(both, F.col("v") > F.col("u")).where("u > v"))
        after = settle(_relabel(large, F.col("v") != F.col("low")).where("u > v"))
        links, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    lone = links.select(F.col("v").alias(node), F.col("v").alias(root)).distinct()
    return links.select(F.col("u").alias(node), F.col("v").alias(root)).unionByName(lone)
