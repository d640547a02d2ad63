"""Connected components by contraction, and attaching group results to members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.common import written

#: A group with more than this share of all rows is attached by a broadcast of fewer than
#: 1 / HEAVY_SHARE rows instead of a shuffle.
HEAVY_SHARE = 1 / 500


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the least node of its component.

    In each round every node points to its least neighbour, chains of pointers are followed, and edges are
    redrawn between what they lead to; loops and doubles vanish. A round leaves at most half of the
    nodes that still have edges, so there are logarithmically many. Only edges and pointers move,
    reduced before each shuffle, and each round is written.
    """
    left = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    roots = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        points = written(points, "cc-points")
        for _ in range(2):
            points = _follow(points, points)
        points = written(points, "cc-points")
        if roots is None:
            roots = points
        else:
            old = roots.join(points.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
            roots = old.select("node", F.coalesce("new", "root").alias("root"))
        roots = written(roots, "cc-roots")
        a = left.join(points.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        b = a.join(points.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = written(
            b.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "cc-edges")
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _follow(points: DataFrame, targets: DataFrame) -> DataFrame:
    then = targets.select(F.col("node").alias("root"), F.col("root").alias("then"))
    return points.join(then, "root").select("node", F.col("then").alias("root"))


def attach(members: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Join written ``groups`` (one row per ``key``, with its row count ``size``) to ``members``.

    The few groups that hold more than HEAVY_SHARE of the rows travel to the members; the rest are
    joined by ``key``.
    """
    rows = groups.agg(F.sum(size)).first()[0] or 0
    heavy = groups.where(F.col(size) > max(1, rows * HEAVY_SHARE))  # under 1 / HEAVY_SHARE rows
    light = groups.join(F.broadcast(heavy.select(key)), key, "left_anti")
    rest = members.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return members.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))
