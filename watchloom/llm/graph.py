"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.store import Store


def components(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; the root is the component's least node.

    Each level hooks every node to its least neighbour, follows the hooks to their ends by doubling, and contracts the
    edges to those ends; levels repeat until no edge is left. This is union-find over tables: nothing is collected, every
    step is an aggregate or an equi-join, and each level is written.
    """
    labels, level = None, 0
    edges = store.put(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), f"{name}-edges-0")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = store.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), f"{name}-hook-{level}-0")
        jump = 0
        while True:
            up = hook.select(F.col("u").alias("q"), F.col("p").alias("pp"))
            moved = hook.join(up, hook.p == up.q).select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
            jump += 1
            moved = store.put(moved, f"{name}-hook-{level}-{jump}")
            hook = moved.select("u", "p")
            if moved.where("moved").isEmpty():
                break
        labels = hook if labels is None else store.put(labels.join(hook.select(F.col("u").alias("q"), F.col("p").alias("pp")), F.col("p") == F.col("q"), "left").select("u", F.coalesce("pp", "p").alias("p")), f"{name}-labels-{level}")
        a, b = hook.select(F.col("u"), F.col("p").alias("pu")), hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        level += 1
        edges = store.put(edges.join(a, "u").join(b, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), f"{name}-edges-{level}")
        if edges.isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("p").alias("root"))
