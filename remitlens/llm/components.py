"""Connected components of a graph whose edges are a DataFrame, by repeated contraction.

In every round each node hooks to its smallest neighbour, hooks are shortened by
pointer jumping, and edges are replaced by edges between what their ends hooked
to. Rounds end when no edge is left, after about the logarithm of the number of
nodes in a component. All tables stay distributed; each round is materialised in
the shared folder, so a lost executor costs a reread and not a recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm.common import cut

#: Times that hooks are shortened in a round.
JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` to ``(node, component)`` for every node that has an edge to another; component is one of its nodes.

    Null ends, loops and repeated edges are ignored; no edges give an empty table.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    labels = None
    while True:
        edges = cut(edges)
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        hooks = cut(hooks.select("node", F.least("node", "least").alias("parent")))
        for _ in range(JUMPS):
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            hooks = hooks.join(up, "parent").select("node", F.col("above").alias("parent"))
        hooks = cut(hooks)
        if labels is None:
            labels = hooks.select("node", F.col("parent").alias("component"))
        else:
            moved = hooks.select(F.col("node").alias("component"), "parent")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = cut(labels)
        end = lambda name: hooks.select(F.col("node").alias(name), F.col("parent").alias(f"{name}_up"))
        edges = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).where("a <> b").distinct()
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
