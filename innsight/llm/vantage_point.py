"""Nearest neighbours by inner product with a vantage-point tree per shard (operator 6).

Inner products become distances by one more coordinate: with R the largest norm, the point
(x, sqrt(R^2 - |x|^2)) is at squared distance |q|^2 + R^2 - 2 q.x from (q, 0). Every vector is in
one tree of a shard of about ``SHARD_ROWS`` rows. Queries go down each tree together: at a
node they split by the nearer child, and a child is left out if the triangle inequality puts all of it farther than
``factor`` times the distance of the query's k-th neighbour so far. Factor 1 is exact, less is faster.
Distances are taken of vectors scaled by a power of two, so that squares of large components don't overflow; scores aren't.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innsight.llm.common import written

K = 20
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 4096, 4096, 128
#: Share of the k-th distance within which children are searched; 1 is exact (figures in the README).
FACTOR = 1.0
#: Slack for rounding in distances, relative to R.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays, root first; rows of a node are ``points[first:last]``; leaves have left = 0."""

    points: np.ndarray
    ids: np.ndarray
    lift: np.ndarray  # the added coordinate of each point
    spans: np.ndarray  # first, last, left child, right child, vantage row
    bounds: np.ndarray  # least and largest distance to the vantage point: left child, right child


def plant(original: np.ndarray, ids: np.ndarray, radius: float, scale: float = 1.0) -> Tree:
    """Build a tree. Halves are by rank, so equal points split like others. ``radius`` is that of the scaled points."""
    points = original * scale
    lift = np.sqrt(np.maximum(radius ** 2 - (points ** 2).sum(1), 0.0))
    order = np.arange(len(points))
    spans, bounds = [[0, len(points), 0, 0, 0]], [[0.0] * 4]
    todo = [0]
    while todo:
        at = todo.pop()
        first, last = spans[at][:2]
        if last - first <= LEAF_ROWS:
            continue
        rows = order[first:last]
        # the point farthest from an arbitrary one spreads the distances
        start = _distances(points[rows], lift[rows], points[rows[0]], lift[rows[0]])
        vantage = rows[np.argmax(start)]
        d = _distances(points[rows], lift[rows], points[vantage], lift[vantage])
        by = np.argsort(d, kind="stable")
        order[first:last], d, half = rows[by], d[by], (last - first) // 2
        spans[at][2:] = [len(spans), len(spans) + 1, vantage]
        bounds[at] = [d[0], d[half - 1], d[half], d[-1]]
        spans += [[first, first + half, 0, 0, 0], [first + half, last, 0, 0, 0]]
        bounds += [[0.0] * 4] * 2
        todo += [len(spans) - 2, len(spans) - 1]
    spans = np.array(spans)
    spans[:, 4] = np.argsort(order)[spans[:, 4]]  # rows are stored in tree order
    return Tree(original[order], ids[order], lift[order], spans, np.array(bounds))


def _distances(points, lift, point, its_lift) -> np.ndarray:
    return np.sqrt(((points - point) ** 2).sum(1) + (lift - its_lift) ** 2)


class Search:
    """Neighbours of a block of queries in one tree; keeps (query row, score, id) of the best k."""

    def __init__(self, tree: Tree, queries: np.ndarray, own_ids: np.ndarray, radius: float, scale: float, k: int, factor: float):
        self.tree, self.queries, self.own_ids, self.k, self.factor, self.scale = tree, queries, own_ids, k, factor, scale
        # a query longer than every point is shortened to their size: its neighbours stay the same
        largest = np.abs(queries).max(1, initial=0.0)
        self.shrink = np.minimum(scale, np.ldexp(1.0, -np.frexp(largest)[1].clip(-1000)))
        self.asked = queries * self.shrink[:, None]
        self.reach = (self.asked ** 2).sum(1) + radius ** 2
        self.slack = SLACK * radius
        self.kth = np.full(len(queries), -np.inf)
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        if len(queries) and len(tree.points):
            self.visit(0, np.arange(len(queries)))

    def visit(self, node: int, active: np.ndarray) -> None:
        first, last, left, right, vantage = self.tree.spans[node]
        if not len(active):
            return
        if not left:
            return self.leaf(first, last, active)
        point, lift = self.tree.points[vantage] * self.scale, self.tree.lift[vantage]
        d = np.sqrt(((self.asked[active] - point) ** 2).sum(1) + lift ** 2)
        low_l, high_l, low_r, high_r = self.tree.bounds[node]
        gap_l = np.maximum(np.maximum(d - high_l, low_l - d), 0)
        gap_r = np.maximum(np.maximum(d - high_r, low_r - d), 0)
        to_left = gap_l <= gap_r
        for mine, order in ((to_left, ((left, gap_l), (right, gap_r))), (~to_left, ((right, gap_r), (left, gap_l)))):
            group = active[mine]
            for child, gap in order:
                self.visit(child, group[gap[mine] <= self.limit(group)])

    def limit(self, group: np.ndarray) -> np.ndarray:
        kth = self.kth[group]
        near = self.factor * np.sqrt(np.maximum(self.reach[group] - 2 * (kth * self.shrink[group] * self.scale), 0)) + self.slack
        return np.where(kth == np.inf, np.inf, near)  # products beyond the largest double are ties

    def leaf(self, first: int, last: int, active: np.ndarray) -> None:
        ids = self.tree.ids[first:last]
        # each product is summed on its own, so equal vectors score equally wherever they stand
        scores = np.einsum("qd,nd->qn", self.queries[active], self.tree.points[first:last])
        good = (scores >= self.kth[active, None]) & (ids[None, :] != self.own_ids[active, None])
        q, n = np.nonzero(good)
        touched = np.isin(self.found[0], active)
        rest = [x[~touched] for x in self.found]
        query = np.concatenate([self.found[0][touched], active[q]])
        score = np.concatenate([self.found[1][touched], scores[q, n]])
        ident = np.concatenate([self.found[2][touched], ids[n]])
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        starts = np.r_[0, np.nonzero(np.diff(query))[0] + 1] if len(query) else np.zeros(0, int)
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        full = place == self.k - 1
        self.kth[query[full]] = score[full]
        best = place < self.k
        self.found = tuple(np.concatenate([r, x[best]]) for r, x in zip(rest, (query, score, ident), strict=True))


def build_index(vectors: DataFrame) -> tuple[DataFrame, dict[int, tuple[float, float, int]]]:
    """One row per shard (dim, shard, and the tree's arrays as bytes), and by dimension (scaled R, scale, shards).

    ``vectors`` has vec_id and embedding (array of double), all usable. Vectors of different
    dimensions never meet, so there is an index for each.
    """
    largest = F.array_max(F.transform("embedding", F.abs))
    squares = F.aggregate(F.transform("embedding", lambda x: x / largest), F.lit(0.0), lambda a, x: a + x * x)
    stats = vectors.groupBy(F.size("embedding").alias("dim")).agg(
        F.max(F.log2(largest) + F.log2(squares) / 2).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    shape = {}
    for r in stats:  # the longest vector's scaled length is in (0.5, 1]
        power = min(1000, max(-1000, math.ceil(r["size"])))
        shape[r["dim"]] = (2.0 ** (r["size"] - power) * (1 + 1e-12), 2.0 ** -power, max(1, math.ceil(r["n"] / SHARD_ROWS)))

    def tree_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = plant(np.stack(rows["embedding"]).astype(np.float64), rows["vec_id"].to_numpy(np.int64), *shape[key[0]][:2])
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], **{name: [getattr(tree, name).tobytes()] for name in _ARRAYS}})

    shards = _by_dimension({d: s for d, (_, _, s) in shape.items()})
    placed = vectors.select("vec_id", "embedding", F.size("embedding").alias("dim"))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards).cast("int"))
    fields = ", ".join(f"{name} binary" for name in _ARRAYS)
    return written(placed.groupBy("dim", "shard").applyInPandas(tree_of, f"dim int, shard int, {fields}"), "vp-index"), shape


_ARRAYS = {"points": np.float64, "ids": np.int64, "lift": np.float64, "spans": np.int64, "bounds": np.float64}


def _by_dimension(values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for d, v in values.items() for x in (d, v)])[F.col("dim")] if values else F.lit(1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` largest inner products of each query, found in the trees.

    Both inputs have vec_id and embedding (array of numbers); a candidate with the query's own id is
    not its neighbour. Defined cases: vectors that are null, zero or hold a null or non-finite component
    and rows with a null id take no part on either side; vectors of another dimension are no
    candidates; a query with fewer than k candidates gets all; equal scores rank by smaller vec_id; rows
    repeated as candidates are candidates each, of rows repeated as queries the least vector counts; empty tables
    give no rows; other columns are left out.
    """
    vectors, queries = (
        df.select(df["vec_id"].cast("bigint").alias("vec_id"), df["embedding"].cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) for df in (vectors, queries)
    )
    index, shape = build_index(vectors)
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    counts = {r["dim"]: r["n"] for r in queries.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {d: max(1, math.ceil(counts.get(d, 0) / QUERY_ROWS)) for d in shape}
    # a cell is one shard and one block of queries, both bounded; each block goes to every shard
    asked = queries.withColumn("dim", F.size("embedding")).where(F.col("dim").isin([*shape]))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), _by_dimension(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), _by_dimension({d: s for d, (_, _, s) in shape.items()}) - 1)))
    cells = index.withColumn("block", F.explode(F.sequence(F.lit(0), _by_dimension(blocks) - 1)))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        dim, arrays = int(left["dim"][0]), {n: np.frombuffer(left[n][0], t) for n, t in _ARRAYS.items()}
        tree = Tree(arrays["points"].reshape(-1, dim), arrays["ids"], arrays["lift"], arrays["spans"].reshape(-1, 5), arrays["bounds"].reshape(-1, 4))
        own = right["vec_id"].to_numpy(np.int64)
        query, score, ident = Search(tree, np.stack(right["embedding"]).astype(np.float64), own, *shape[dim][:2], k, factor).found
        return pd.DataFrame({"query_id": own[query], "vec_id": ident, "score": score})

    keys = ("dim", "shard", "block")
    found = cells.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
