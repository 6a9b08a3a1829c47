"""Connected components as DataFrames: contraction to the least neighbour, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalfold.llm.store import materialize


def _flatten(hook: DataFrame) -> DataFrame:
    """hook (node, to) with to < node: follow the pointers to their ends."""
    while True:
        far = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hook = materialize(hook.join(far, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
        if hook.where("moved").isEmpty():
            return hook.select("node", "to")
        hook = hook.select("node", "to")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of edges (a, b): comp is the least node that links lead to.

    Each round hooks every component to its least neighbour, flattens the hooks and contracts the edges; the
    components of a connected part at least halve. Neighbours are only ever reduced by min, so a node with many links
    is no hot group.
    """
    labels = None
    live = edges.where("a <> b")
    while True:
        both = live.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
        least = materialize(both.groupBy("node").agg(F.min("to").alias("to")), "least")
        hook = least.where("to < node")
        if hook.isEmpty():
            if labels is None:
                return least.select("node", F.col("to").alias("comp"))
            return labels
        flat = _flatten(hook)
        ends = flat.select(F.col("node").alias("comp"), F.col("to"))
        if labels is None:
            labels = least.select("node", F.col("node").alias("comp"))
        labels = materialize(labels.join(ends, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        ea, eb = (flat.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = live.join(ea, "a", "left").join(eb, "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        live = materialize(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
