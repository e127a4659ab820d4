"""Exact top-k inner-product search: a ball tree per shard, branch and bound over streamed queries.

Vectors are dealt to shards of at most SHARD_VALUES components. A task builds a shard's ball
tree once and streams all queries through it, a batch at a time: children are visited by
their largest upper bound (query . centre + |query| * radius), and a subtree is
left out for the queries whose current kth score exceeds its bound. The kth score
is shared: shards are searched in waves, of a sixteenth, a quarter and all of them, and
what a wave finds raises the kth scores with which the next begins; within a task they
keep rising. A wave's finds are merged in two levels.

Products are exact: sums that float64 holds exactly are taken in float64, larger ones in
64-bit integers, and those that might not fit there in Python's; a score of more than 63
bits, or a component that has more once scaled, is an error.

Cases: a vector that is null or holds a null or non-finite component, or has a null id,
takes no part, as query or candidate; a shorter vector counts as continued by zeros, so an
empty one scores 0 with all; equal scores go to the smaller id; repeated ids are
separate candidates, but none that equals the query's id; fewer than k candidates
give all of them; an empty table gives an empty table. Further columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codeloom.llm._spark import Scratch, arrow_rows

K = 10
#: Components and rows of a shard, queries answered at once, and rows of a leaf, at most.
SHARD_VALUES, SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 1 << 22, 1 << 14, 1024, 64
#: Shares of the shards that have been searched at the end of each wave.
WAVES = (1 / 16, 1 / 4, 1.0)
_NONE = np.iinfo(np.int64).min


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 1024) -> DataFrame:
    """(id, v): each component x as floor(factor * x), x as double; vectors that take no part are left out."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    whole = lambda x: F.when(F.abs(x * factor) < float(1 << 63), F.floor(x * factor).cast("long")).otherwise(F.raise_error(F.lit("a scaled component has more than 63 bits")))
    return rows.select("id", F.transform("v", whole).alias("v"))


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The exact inner products of rows of integers, as 64-bit integers."""
    most = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    bound = most(queries) * most(points) * max(1, queries.shape[1])
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return queries @ points.T
    exact = queries.astype(object) @ points.astype(object).T
    if exact.size and max(abs(exact.min()), abs(exact.max())) >= 1 << 63:
        raise OverflowError("a score has more than 63 bits")
    return exact.astype(np.int64)


class BallTree:
    """Balls over the rows of an integer matrix: centre, radius, and the range of ``order`` that each node holds."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self._points, self.order = points.astype(np.float64), np.arange(len(points))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        if len(points):
            self._build(0, len(points), leaf)
        self.points = points[self.order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.norm = np.sqrt((self.centre**2).sum(1)) if len(points) else self.radius
        del self._points

    def _build(self, a: int, b: int, leaf: int) -> int:
        own, node = self._points[self.order[a:b]], len(self.centre)
        centre = own.mean(0)
        apart = np.sqrt(((own - centre) ** 2).sum(1))
        self.centre.append(centre)
        self.radius.append(float(apart.max()) * (1 + 1e-9) + 1e-6)
        self.span.append((a, b))
        self.children.append(None)
        if b - a > leaf:
            far = own[apart.argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            by = np.argsort(own @ (other - far), kind="stable")
            self.order[a:b] = self.order[a:b][by]
            middle = (a + b) // 2
            self.children[node] = (self._build(a, middle, leaf), self._build(middle, b, leaf))
        return node


class Best:
    """The k best (score, id) of each query so far; ties to smaller ids. floor: scores that the kth best reaches elsewhere already."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor
        self.score = np.full((len(ids), k), _NONE, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.where(ids[None, :] == self.ids[rows][:, None], _NONE, score)
        better = (score >= self.kth(rows)[:, None]).any(1)
        rows, score = rows[better], score[better]
        if len(rows):
            both = np.concatenate([self.score[rows], score], 1)
            names = np.concatenate([self.found[rows], np.broadcast_to(ids, score.shape)], 1)
            # ~ falls as the score rises, and has no overflow.
            top = np.lexsort((names, ~both), axis=1)[:, : self.k]
            self.score[rows] = np.take_along_axis(both, top, 1)
            self.found[rows] = np.take_along_axis(names, top, 1)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """Branch and bound: best nodes first, for all queries that a node's bound does not rule out."""
    best, plain = Best(query_ids, k, floor), queries.astype(np.float64)
    norm = np.sqrt((plain**2).sum(1))
    ids = ids[tree.order]
    if not len(ids):
        return best

    def bound_of(node: int, rows: np.ndarray) -> np.ndarray:
        """Of the products with the node's points, with room for rounding."""
        largest = norm[rows] * (tree.norm[node] + tree.radius[node])
        return plain[rows] @ tree.centre[node] + norm[rows] * tree.radius[node] + largest * 1e-12 * max(1, queries.shape[1]) + 1e-3

    def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
        keep = bound >= best.kth(rows).astype(np.float64)
        rows, bound = rows[keep], bound[keep]
        if not len(rows):
            return
        if tree.children[node] is None:
            a, b = tree.span[node]
            best.offer(rows, products(queries[rows], tree.points[a:b]), ids[a:b])
            return
        bounds = [(bound_of(c, rows), c) for c in tree.children[node]]
        # Queries nearer to one child visit that child first.
        first = bounds[0][0] >= bounds[1][0]
        for side in (first, ~first):
            ahead, behind = (0, 1) if side is first else (1, 0)
            if side.any():
                for i in (ahead, behind):
                    visit(bounds[i][1], rows[side], bounds[i][0][side])

    visit(0, np.arange(len(queries)), np.full(len(queries), np.inf))
    return best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of integers, continued by zeros."""
    size = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


_FOUND = "query_id long, vec_id long, score long"


def _answers(k: int, width: int):
    """For mapInArrow over rows (shard, query, id, v, floor), a shard's vectors before its queries: (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, points, tree = None, [], [], None
        for batch in batches:
            of, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(of)]):
                if a == b:
                    continue
                if of[a] != shard:
                    shard, ids, points, tree = of[a], [], [], None
                own, vectors = batch.column(2).slice(a, b - a).to_numpy(), _matrix(batch.column(3).slice(a, b - a), width)
                if not asks[a]:
                    ids.append(own)
                    points.append(vectors)
                    continue
                if tree is None:
                    points = np.concatenate([np.zeros((0, width), np.int64), *points])
                    ids = np.concatenate([np.zeros(0, np.int64), *ids])
                    tree = BallTree(points)
                floor = batch.column(4).slice(a, b - a).to_numpy()
                for at in range(0, b - a, BLOCK_QUERIES):
                    part = slice(at, at + BLOCK_QUERIES)
                    best = search(tree, ids, vectors[part], own[part], k, floor[part])
                    row, rank = np.nonzero((best.score > _NONE) & (best.score >= best.floor[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(best.ids[row]), pa.array(best.found[row, rank]), pa.array(best.score[row, rank])], ["query_id", "vec_id", "score"])

    return run


def _top(found: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of scaled() that satisfy the Column is_query, the k best others."""
    with Scratch() as s:
        rows = s.cut(rows.select(F.col("id").cast("long").alias("id"), "v"), "vectors")
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).head()
        n, width = size["n"], max(1, size["width"])
        shards = max(1, -(-n * width // SHARD_VALUES), -(-n // SHARD_ROWS))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
        queries = rows.where(is_query).select("id", "v")
        best, low = None, 0
        with arrow_rows(rows.sparkSession, max(64, min(10_000, (1 << 21) // width))):
            for share in WAVES:
                high = max(1, round(share * shards))
                if high <= low:
                    continue
                asked = queries
                if best is None:
                    asked = asked.withColumn("floor", F.lit(_NONE))
                else:
                    kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
                    asked = asked.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE)))
                asked = asked.select(F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("shard"), F.lit(True).alias("query"), "id", "v", "floor")
                held = dealt.where(F.col("shard").between(low, high - 1)).select("shard", F.lit(False).alias("query"), "id", "v", F.lit(_NONE).alias("floor"))
                streams = held.union(asked).repartition(high - low, "shard").sortWithinPartitions("shard", "query")
                found = streams.mapInArrow(_answers(k, width), _FOUND)
                if best is not None:
                    found = found.union(best.select("query_id", "vec_id", "score"))
                some = _top(found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16))), k, "query_id", "part").drop("rank")
                best, low = s.cut(_top(some, k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "best"), high
        return s.keep(best)
