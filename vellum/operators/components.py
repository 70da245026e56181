"""Connected components of a graph given as an edge table, every component named by its smallest node.

Alternating star contraction: each round hangs the larger neighbours of every node, then the smaller ones, on the smallest
neighbour.  A round is two aggregations with map-side combine and two joins; it needs about log(n) rounds.  When a *checked*
count shows that the remaining stars are few, one task finishes them by union-find; the result is the same either way.

Defined results: loops and repeated edges do not matter, null ends are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import discard, written

#: Edges that one task may finish (about 10 MB).
ONE_TASK_EDGES = 200_000


def hung(stars: DataFrame, large: bool) -> DataFrame:
    """One half of a round over edges ``(a, b)`` with a > b."""
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else stars
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def union_find(frame: pd.DataFrame) -> pd.DataFrame:
    """Stars of a few edges in memory; the root is always the smaller node."""
    root: dict = {}

    def find(x: object) -> object:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    pairs = list(zip(frame["a"], frame["b"]))
    names = list(pairs[0][0]) if pairs and isinstance(pairs[0][0], dict) else None  # nodes of several fields
    for a, b in pairs:
        a, b = (find(tuple(x.values()) if names else x) for x in (a, b))
        if a != b:
            root[max(a, b)] = min(a, b)
    out = lambda x: dict(zip(names, x)) if names else x
    return pd.DataFrame([(out(x), out(find(x))) for x in list(root)], columns=["node", "root"])


def components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task: int = ONE_TASK_EDGES, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has an edge to another one."""
    kind = edges.schema[src].dataType.simpleString()
    pair = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(f"`{src}` is not null and `{dst}` is not null and `{src}` <> `{dst}`")
    stars, before = written(pair.distinct(), "stars"), None
    for _ in range(rounds):
        count, mark = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if count <= one_task:
            return stars.groupBy(F.lit(0).alias("all")).applyInPandas(lambda frame: union_find(frame), f"node {kind}, root {kind}")
        if (count, mark) == before:
            break
        before, old = (count, mark), stars
        stars = written(hung(hung(stars, True), False), "stars")
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
