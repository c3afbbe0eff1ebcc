"""Distributed connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component (the smallest node that edges reach) for each node of an edge (a, b).

    Each round hooks every node to its smallest smaller neighbour, jumps pointers until the
    trees are flat, and replaces the ends of all edges by their roots; edges inside a tree go.
    Every step is written, so a lost executor costs one step. Edges with a null end, and from
    a node to itself, don't count. Repeated edges are harmless; no edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    pair = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    left = scratch.save(edges.where("a <> b").select(*pair).distinct(), "edges")
    labels = scratch.save(left.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not left.isEmpty():
        tree = scratch.save(left.groupBy("u").agg(F.min("v").alias("up")), "tree")
        while True:
            jump = tree.alias("x").join(tree.alias("y"), F.col("x.up") == F.col("y.u"), "left")
            flatter = scratch.save(jump.select("x.u", F.coalesce("y.up", "x.up").alias("up"), F.col("y.up").isNotNull().alias("moved")), "tree")
            tree, moved = flatter.drop("moved"), not flatter.where("moved").isEmpty()
            if not moved:
                break

        def root(rows: DataFrame, column: str) -> DataFrame:
            of = tree.select(F.col("u").alias("_u"), F.col("up").alias("_up"))
            return rows.join(of, rows[column] == F.col("_u"), "left").withColumn(column, F.coalesce("_up", column)).drop("_u", "_up")

        labels = scratch.save(root(labels, "component"), "labels")
        moved_edges = root(root(left, "u"), "v").where("u <> v")
        left = scratch.save(moved_edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return labels
