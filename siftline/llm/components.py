"""Connected components of an undirected graph as repeated joins, with the lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, anew, checkpoint


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, root) for each end of an edge: root is the smallest id that links reach.

    In each round every node points to its first neighbour, by a hash of id and round, if that stands before
    itself, then to where that one points; edges are rewritten to what their ends point to, and loops and
    repeats go. The hash keeps chains of pointers short whatever the ids' order, so that each round leaves a
    fraction of the nodes; the rounds end when no edge is left, and their pointers are put together. Null ends
    are left out, loops and repeated edges do no harm, no edges give no rows.
    All steps are plain joins and minimums with partial aggregation, so a node of very many neighbours is
    split by adaptive execution.
    """
    stash = Stash(edges.sparkSession)
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    e = stash(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    loops = e.where("a = b").select("a").distinct()
    e = e.where("a <> b")
    rounds = []
    while rounds == [] or e.limit(1).count():
        rank = lambda c, k=len(rounds): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
        near = e.select("a", "b").union(e.select("b", "a")).toDF("id", "near").groupBy("id").agg(F.min(rank("near")).alias("near"))
        first = stash(near.select("id", F.least(F.col("near"), rank("id"))["v"].alias("to")))
        up = first.select(anew("id").alias("to"), F.col("to").alias("over"))
        hop = stash(first.join(up, "to").select("id", F.col("over").alias("root")))
        rounds.append(hop)
        ends = e.join(hop.select(anew("id").alias("a"), F.col("root").alias("x")), "a").select("b", "x")
        ends = ends.join(hop.select(anew("id").alias("b"), F.col("root").alias("y")), "b").select("x", "y")
        e = stash(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    roots = rounds[-1]
    for hop in reversed(rounds[:-1]):
        later = roots.select(anew("id").alias("root"), F.col("root").alias("last"))
        roots = hop.join(later, "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    roots = stash(roots)
    least = roots.groupBy("root").agg(F.min("id").alias("least")).select(anew("root"), "least")
    named = roots.join(least, "root").select("id", F.col("least").alias("root"))
    out = checkpoint(stash(named.union(loops.join(roots, loops["a"] == roots["id"], "left_anti").select("a", "a"))))
    stash.drop()
    return out
