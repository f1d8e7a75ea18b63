"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of edges (src, dst); component is the smallest id reachable.

    Each round moves every node to its smallest neighbour (if smaller than itself) and contracts
    the edges; a hub costs one partial minimum, never a list of its neighbours. Each round's
    edges and moves are scratch tables, so lineage stays short and nothing goes to the driver but
    whether edges are left. The moves are composed from the last round, the smallest, backwards.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = materialise(both.filter("src <> dst").distinct(), "edges")
    moves = []
    while not both.isEmpty():
        move = both.groupBy("src").agg(F.min("dst").alias("_least")).select(F.col("src").alias("id"), F.least("src", "_least").alias("to"))
        move = materialise(move, "moves")
        moves.append(move)
        left = move.select(F.col("id").alias("src"), F.col("to").alias("a"))
        right = move.select(F.col("id").alias("dst"), F.col("to").alias("b"))
        both = both.join(left, "src").join(right, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        both = materialise(both.distinct(), "edges")
    if not moves:
        return both.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    found = moves[-1].select("id", F.col("to").alias("component"))
    for move in reversed(moves[:-1]):
        later = found.select(F.col("id").alias("to"), "component")
        found = move.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    return found
