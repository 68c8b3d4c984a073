"""Connected components of an edge table, by hooking to smaller neighbours and contraction; nothing is gathered on the driver.

Defined cases. Edges from a node to itself or with a null end join nothing. Repeated and reversed edges count once. Ties
can't occur: a component is named by its smallest node. No edges: no rows. Only a and b are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled

#: Parts into which the members of one node are dealt wherever they follow it, so that a star isn't one task.
SALTS = 8


def _followed(pairs: DataFrame, step: DataFrame) -> DataFrame:
    """pairs (node, to) with `to` replaced by where step (node, to) sends it; a node that step lacks stays."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    every = step.select(F.col("node").alias("to"), F.col("to").alias("further"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return dealt.join(every, ["to", "salt"], "left").select("node", F.coalesce("further", "to").alias("to"))


def components(edges: DataFrame, told: list | None = None) -> DataFrame:
    """(node, comp) for every node of edges (a, b), comp being the smallest node that it reaches.

    Each round hooks every node to its smallest neighbour if that is smaller, and follows hooks by doubling (four times
    as far with each table written) until every node of a tree points to its root. Then the ends of edges are replaced
    by their roots. A root has no smaller neighbour, so at most half of the nodes are left: there are as many rounds as
    the logarithm of the nodes, each of as many doublings as the logarithm of a tree's depth. Smallest neighbours are
    combined before the shuffle. At the end the rounds' hooks are composed. told: gets a row for each table written.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    left = settled(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while left.limit(1).count():
        both = left.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(left.select(F.col("a").alias("node"), F.col("b").alias("to")))
        hooks = settled(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")))
        while True:
            twice = _followed(hooks, hooks)
            further = settled(_followed(twice, twice))
            if told is not None:
                told.append(len(rounds))
            moved = further.join(hooks.select("node", F.col("to").alias("was")), "node").where("to <> was").limit(1).count()
            hooks = further
            if not moved:
                break
        rounds.append(hooks)
        one = _followed(left.select(F.col("b").alias("node"), F.col("a").alias("to")), hooks).select(F.col("node").alias("b"), F.col("to").alias("x"))
        two = _followed(one.select(F.col("x").alias("node"), F.col("b").alias("to")), hooks).select(F.col("node").alias("x"), F.col("to").alias("y"))
        left = settled(two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0)
    out = rounds[0]
    for later in rounds[1:]:
        out = _followed(out, later)
    return settled(out.select("node", F.col("to").alias("comp")))
