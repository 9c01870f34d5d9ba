"""Connected components of an edge table, distributed, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest node.

    Each round hooks every node to its smallest neighbour, shortens the pointers
    to their roots by doubling, and contracts the edges to those between roots.
    At least half the nodes vanish a round, and a chain of n pointers takes log n
    doublings.  Every intermediate result is a written table.  Self-loops keep
    their node; edges with a null end are ignored; an empty table gives no rows.
    A hub is a hot join key on one side only, which adaptive skew joins split.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    graph = materialize(both.union(both.select("b", "a")).distinct(), "edges")
    total = None
    while True:
        hooks = materialize(graph.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = materialize(hooks.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")), "hooks")
            moved = not jumped.where("moved").isEmpty()
            discard(hooks)
            hooks = jumped
            if not moved:
                break
        roots = hooks.select("node", "root")
        if total is None:
            whole = roots
        else:
            whole = materialize(total.join(roots.select(F.col("node").alias("t_root"), F.col("root").alias("higher")), F.col("root") == F.col("t_root"), "left").select("node", F.coalesce("higher", "root").alias("root")), "roots")
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = materialize(graph.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        discard(graph)
        total, graph = whole, contracted
        if graph.isEmpty():
            return total.select("node", F.col("root").alias("component"))
