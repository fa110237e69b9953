"""Connected components of an edge table, by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import lookup, staged


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes of the edges (a, b); loops and repeated edges do no harm.

    Each round a node takes the smallest label among its neighbours', then its label's label, until none changes. A
    node with very many edges is no burden: its neighbours' labels are combined before the shuffle, and its own label
    reaches them by broadcast.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    both = staged(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    n_edges = both.count()
    labels = staged(both.groupBy("x").agg(F.count("*").alias("degree"), F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = lookup(both, labels.select("x", "label", "degree"), "x", "degree", n_edges, nulls=False).groupBy("y").agg(F.min("label").alias("near"))
        taken = labels.join(near, labels.x == near.y).select("x", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        taken = staged(taken, "taken")
        # many nodes can share a label, but its own row is one: pre-aggregate the label's side
        sizes = taken.groupBy("label").count()
        jump = sizes.join(taken.select(F.col("x").alias("label"), F.col("label").alias("far")), "label")
        jumped = lookup(taken, jump, "label", "count", n_edges, nulls=False).select("x", "degree", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        after = staged(jumped, "labels")
        changed = after.filter("label <> old").limit(1).count()
        labels = after.select("x", "degree", "label")
        if not changed:
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
