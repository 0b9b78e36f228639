"""Connected components of links, by randomised contraction over Spark joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.skew import join_counted
from ledgerloom.session import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """Which nodes of ``links`` (a, b) reach each other.

    Every round puts the nodes in a new pseudo-random order, hooks each to the
    first of itself and its neighbours, and contracts the links along the hooks.
    In a random order a quarter of the nodes is expected to go at least, however
    the links lie (a chain too), so the number of rounds grows with the
    logarithm of the nodes.  Then the rounds' hooks are followed back from the
    last to the first.  A node of very many links, or one that very many nodes
    hook to, is spread over all tasks.

    Returns (node, component), one row per node; a component is known by one of
    its nodes, not by the smallest.  Links with a null end, and links of a node
    to itself, are ignored; an empty table gives an empty result.
    """
    both = links.select("a", "b").filter("a <> b")
    edges = materialise(both.union(both.select("b", "a")).distinct(), "links")
    rounds: list[DataFrame] = []
    while n := edges.count():

        def place(node: Column) -> Column:
            return F.struct(F.xxhash64(node, F.lit(len(rounds))).alias("at"), node.alias("node"))

        first = F.least(F.min(place(F.col("b"))), place(F.col("a")))
        hooks = materialise(edges.groupBy("a").agg(first["node"].alias("to"), F.count("*").alias("rows")), "hooks")
        half = materialise(join_counted(edges, hooks, "a", n).select(F.col("to").alias("x"), "b"), "half")
        whole = join_counted(half, hooks.withColumnsRenamed({"a": "b", "to": "y"}), "b", n)
        shorter = materialise(whole.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        discard(edges)
        discard(half)
        edges = shorter
        rounds.append(hooks)
    discard(edges)

    labels = links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    while rounds:
        hooks = rounds.pop()
        # A node without links in the next round stands for its component.
        known = hooks.groupBy("to").agg(F.count("*").alias("rows")).join(labels.withColumnRenamed("node", "to"), "to", "left")
        known = materialise(known.withColumn("component", F.coalesce("component", "to")), "roots")
        found = join_counted(hooks.select("a", "to"), known, "to", hooks.count())
        labels = materialise(found.select(F.col("a").alias("node"), "component"), "labels")
        discard(known)
        discard(hooks)
    return labels
