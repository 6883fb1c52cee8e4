"""Connected components of an edge table by repeated contraction.

Each round maps every node to its smallest neighbour (or itself), relabels
the edges with that map and drops loops and repeats; at least all local
maxima vanish, so few rounds are needed.  A hub is one key of a partial
aggregate and of equi joins that Spark may split, never a collected group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import checkpointed

# Each round writes three tables of node pairs.
FILES_PER_CORE = 4


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: nodes have equal
    roots exactly if they are connected.  An empty table gives no rows."""
    both = edges.where("a <> b").select("a", "b")
    turned = both.select(F.col("b").alias("a"), F.col("a").alias("b"))
    live = checkpointed(both.unionByName(turned).distinct(), FILES_PER_CORE)
    members = None
    while True:
        step = checkpointed(
            live.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")),
            FILES_PER_CORE,
        )
        if members is None:
            members = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            moved = step.select(F.col("a").alias("root"), "to")
            members = members.join(moved, "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
        members = checkpointed(members, FILES_PER_CORE)
        left = step.select("a", F.col("to").alias("x"))
        right = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        live = live.join(left, "a").join(right, "b").where("x <> y")
        live = checkpointed(live.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), FILES_PER_CORE)
        if live.isEmpty():
            return members
