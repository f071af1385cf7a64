"""Connected components of a large graph: contraction within partitions, then by alternating stars; nothing is collected."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Edges that one task contracts: some 16 MB.
EDGES = 1_000_000


def star_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for the graph of the pairs a - b, nodes that are their own root left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        u, v = root[x], root[y]
        if np.array_equal(u, v):
            break
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars: the same components, and short ways within them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches if x.num_rows]
        if got:
            a, b = star_labels(*(np.concatenate(c) for c in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. large: every larger neighbour moves to the smallest one; else the smaller ones and oneself."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one root, and no root has one."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph of ``edges(a long, b long)``.

    Returns (node, component) for every node that has an edge to another; component is the smallest node reachable.
    A round contracts within partitions of up to ``EDGES`` edges, as many as there are then, and, unless one held all
    edges, takes one large-star and one small-star step (aggregations with partial sums, and joins); it is cut by a
    checkpoint in the shared folder. The rounds grow with the logarithm of a component's width.
    """
    edges = edges.select("a", "b").filter("a <> b").checkpoint()
    while True:
        parts = max(1, math.ceil(edges.count() / EDGES))
        edges = _contract(edges.coalesce(parts)).checkpoint()
        if parts == 1 or _are_stars(edges):
            break
        edges = _star(_star(edges, True), False).checkpoint()
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
