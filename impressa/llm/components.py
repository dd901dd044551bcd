"""Connected components over an edge table, by contraction.

Every round each node points to its neighbour of smallest hash (or to
itself), pointers are followed a few steps, and edges are rewritten to the
nodes pointed at.  The hash order makes the local minima about a third of the
nodes whatever the ids are, so the edge table shrinks by a factor each round
and chains of consecutive ids need no more rounds than others.  All
aggregates combine before the shuffle; joins put a hub on one side with one
row, so AQE can split the other.  Rounds are cut by tables staged under
``spark.checkpoint.dir``; nothing comes to the driver.

Null ends and self loops are ignored; repeated edges count once; no edges
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.sources.sinks import stage


def _follow(p: DataFrame) -> DataFrame:
    q = p.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
    return p.join(q, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"))


def connected_components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(a, b) longs -> (node, root): one row per node with an edge, one root per component."""
    a, b = edges.columns[:2]
    e = stage(edges.where(F.col(a) != F.col(b))
              .select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).distinct(), "cc-edges")
    maps = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = F.min_by("b", F.xxhash64("b"))
        p = both.groupBy(F.col("a").alias("node")).agg(near.alias("near"))
        hn, hm = F.xxhash64("node"), F.xxhash64("near")
        lower = (hm < hn) | ((hm == hn) & (F.col("near") < F.col("node")))
        p = p.select("node", F.when(lower, F.col("near")).otherwise(F.col("node")).alias("parent"))
        p = stage(p, "cc-parents")
        q = p
        for _ in range(jumps):
            q = _follow(q)
        q = stage(q, "cc-map") if jumps else p
        maps.append(q)
        ea = e.join(q.select(F.col("node").alias("a"), F.col("parent").alias("x")), "a")
        eb = ea.join(q.select(F.col("node").alias("b"), F.col("parent").alias("y")), "b")
        e = stage(eb.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                  "cc-edges")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select("node", F.col("parent").alias("root"))
    for q in maps[1:]:
        nxt = q.select(F.col("node").alias("root"), F.col("parent").alias("up"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return stage(out, "cc-labels")
