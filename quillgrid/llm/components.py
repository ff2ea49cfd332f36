"""Connected components of a graph given as an edge table, by randomized contraction.

In every round each node points to the neighbour (or itself) of least hash, pointers are followed a few steps, and
the edges are rewritten between the nodes pointed to; equal ends go. Hashes differ by round, so a round leaves an
expected constant part of the nodes of any graph, and rounds are logarithmic. Hubs meet only partial aggregates and
joins whose two sides are read from written tables, which adaptive execution can split. No side is broadcast: there are
several joins a round, and the last plan has one for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import drop_scratch, materialize, merging


def components(edges: DataFrame, name: str = "components") -> DataFrame | None:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable type); None without edges.

    Self-links and repeated edges are allowed; nodes with only self-links are not returned.
    """
    kept = materialize(edges.where("a != b").select("a", "b").distinct(), f"{name}-edges")
    maps = []
    while not kept.isEmpty():
        salt = F.lit(len(maps))
        both = kept.union(kept.select("b", "a")).toDF("u", "v")
        least = F.min(F.struct(F.xxhash64("v", salt).alias("h"), F.col("v")))
        step = both.groupBy("u").agg(least.alias("m"))
        own = F.struct(F.xxhash64("u", salt).alias("h"), F.col("u").alias("v"))
        step = materialize(step.select("u", F.least(F.col("m"), own)["v"].alias("p")), f"{name}-step")
        for _ in range(2):
            step = _follow(step, step)
        step = materialize(step, f"{name}-map")
        maps.append(step)
        a = kept.join(merging(step.toDF("a", "pa")), "a")
        moved = a.join(merging(step.toDF("b", "pb")), "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        done, kept = kept, materialize(moved.distinct(), f"{name}-edges")
        drop_scratch(done)
    if not maps:
        return None
    out = maps[-1]
    for step in reversed(maps[:-1]):  # a node that has no edge left keeps where it is
        last = out.toDF("p", "root")
        out = step.join(merging(last), "p", "left").select("u", F.coalesce("root", "p").alias("p"))
    return out.toDF("node", "root")


def _follow(first, then):
    return first.join(merging(then.toDF("p", "q")), "p").select("u", F.col("q").alias("p"))
