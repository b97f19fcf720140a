"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Edges up to which the nodes' smallest neighbours are broadcast (two nodes an edge, 16 bytes each, at most); beyond it
#: a node's edges are dealt over so many tasks.
BROADCAST_EDGES, SALTS = 100_000, 16


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Each round links neighbours to the smallest node near them: larger neighbours first, then smaller ones. Edges stay
    slim and distributed, each round is written to the shared folder, and paths shrink to stars in some log n rounds.
    A node's larger neighbours may be a third of the table, so its edges never meet in one task: the smallest neighbours
    are broadcast while there are few edges, and else joined by salted keys. A node's smaller neighbours are few, as each
    came from one edge of the node, and are gathered.
    """
    e = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, n = None, e.count()
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        if n <= BROADCAST_EDGES:
            large = both.join(F.broadcast(least), "a")
        else:
            salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            large = both.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS))).join(salted, ["a", "salt"])
        large = large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        smaller = large.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("s"))
        rest = F.explode(F.concat(F.array("a"), F.expr("slice(s, 2, size(s))"))).alias("a")
        after = written(smaller.select(rest, F.get("s", F.lit(0)).alias("b")), "edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        forget(e)
        e, n = after, state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    e = e.distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
