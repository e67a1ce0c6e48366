"""Distributed connected components by contraction along hashed pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, save


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another one; component is the smallest node reachable.

    Each round every node points at the one of itself and its neighbours that a
    hash of the node and the round puts first, pointers are doubled once, and the
    edges are contracted to what they point at.  The hash makes the order of the
    names irrelevant: a chain loses about two thirds of its nodes a round however
    they are numbered, so rounds are logarithmic.  Pointers are put together from
    the last round, the smallest, back to the first; then each component is named
    by its smallest node.  All state is in saved tables: joins have a shuffle on
    both sides, which adaptive execution can split where a hub is hot, and nothing
    is collected.  Rows with a null end and self-loops are ignored; repeated
    edges count once; no edges give an empty table.
    """
    a, b = F.col(src), F.col(dst)
    ends = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("u"), b.alias("v"))
    e = save(ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    parents: list[DataFrame] = []
    while not e.isEmpty():
        turn = len(parents)

        def first(c: str, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))

        near = save(e.groupBy("u").agg(F.min(first("v")).alias("v")).select("u", F.least("v", first("u"))["n"].alias("p")), "parents")
        up = near.select(F.col("u").alias("p"), F.col("p").alias("q"))
        parent = save(near.join(up, "p").select("u", F.col("q").alias("p")), "grandparents")
        pu = parent.select("u", F.col("p").alias("a"))
        pv = parent.select(F.col("u").alias("v"), F.col("p").alias("b"))
        nxt = save(e.join(pu, "u").join(pv, "v").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        discard(near, e)
        parents.append(parent)
        e = nxt
    if not parents:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    root = parents[-1]
    for parent in parents[-2::-1]:
        further = root.select(F.col("u").alias("p"), F.col("p").alias("q"))
        root = parent.join(further, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
    found = save(root, "roots")
    discard(e, *parents)
    named = save(found.groupBy("p").agg(F.min("u").alias("component")), "least")  # apart from the join, where a giant component's partition can then be split
    return found.join(named, "p").select(F.col("u").alias("node"), "component")
