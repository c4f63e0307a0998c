"""Exact top-k inner-product search by best-first search in M-trees.

Inner products become distances in a metric space: with one more component that brings every
candidate to the common length ``R``, and 0 for the query, the squared distance is
``|q|^2 + R^2 - 2 q.x``, so nearer means a greater product.

The index is one M-tree of pages.  Its top page holds at most ``MOST_PIVOTS`` routing vectors, a
bounded sample of the rows; every row belongs to the nearest one, and the rows of a routing vector
are dealt into subtrees of bounded size.  A subtree is built once, by one task, and kept in a table
of the shared folder: pages of entries that store a routing vector, its covering radius and its
distance to the parent's vector.

A search takes pages from a heap by the least distance they can hold and skips an entry without
computing its distance whenever the stored distances and the triangle inequality already exclude
it.  Queries are searched in batches: a page is read once for all queries that it may still help.
First every query is searched in its own subtree.  The k-th best of that is its bound; by the top
page's radii it then goes only to subtrees that can beat it, and the k best of all meet in a final
ranking.  Scores are exact integers; bounds get a little slack for rounding, and entries at the
bound itself are kept, so ties are resolved by id.

How much the bounds exclude depends on the data: for vectors without clusters, such as random
directions in 64 dimensions, all pages hold candidates at nearly the same distance and the exact
search reads them all.

Defined results: vectors that are null or hold null or non-finite components, and rows with a
null id, take no part; shorter vectors count as padded with zeros; of rows that share an id only
the one with the least vector takes part; equal vectors of different ids are different candidates;
fewer than k candidates give as many rows; an empty table gives none; scores beyond 62 bits raise.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_batches

PAGE = 64
FAN = 16
MOST_PIVOTS = 1024
MOST_SUBTREES = 1 << 16
ROUTED = 1 << 22  # distances of queries to subtrees that a task holds at once
_NONE = np.iinfo(np.int64).max


@dataclass
class Node:
    """A page: leaves hold a range of the subtree's rows, others routing entries with covering radii."""

    parent_distance: np.ndarray
    vectors: np.ndarray | None = None
    radii: np.ndarray | None = None
    children: list[Node] | None = None
    rows: tuple[int, int] = (0, 0)


@dataclass
class Subtree:
    """Rows in the order of their pages, and the pages over them."""

    ids: np.ndarray
    rows: np.ndarray  # integers
    root: Node
    radius: float  # around the top page's routing vector

    def points(self, reach2: float) -> np.ndarray:
        return lifted(self.rows, reach2)


def lifted(x: np.ndarray, r2: float) -> np.ndarray:
    """Vectors with one more component that gives them the length ``sqrt(r2)``."""
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, r2 - (x**2).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)[None]))


def matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _pages(points: np.ndarray, numbers: np.ndarray, centre: np.ndarray, order: list[np.ndarray], at: int) -> Node:
    """Bulk-loads: seeds far apart, every point to its nearest seed, then down each part."""
    own = points[numbers]
    if len(numbers) <= PAGE:
        order.append(numbers)
        return Node(np.linalg.norm(own - centre, axis=1), rows=(at, at + len(numbers)))
    seeds, gap = [0], np.linalg.norm(own - own[0], axis=1)
    while len(seeds) < FAN and gap.max() > 0:
        seeds.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(own - own[seeds[-1]], axis=1))
    if len(seeds) == 1:  # all points are equal: pages of equal shares
        parts = np.array_split(np.arange(len(numbers)), min(FAN, -(-len(numbers) // PAGE)))
        seeds = [int(p[0]) for p in parts]
    else:
        near = distances(own, own[seeds]).argmin(axis=1)
        near[seeds] = np.arange(len(seeds))
        parts = [np.flatnonzero(near == s) for s in range(len(seeds))]
    routing, children = own[seeds], []
    for p, r in zip(parts, routing, strict=True):
        children.append(_pages(points, numbers[p], r, order, at))
        at += len(p)
    radii = np.array([np.linalg.norm(own[p] - r, axis=1).max() for p, r in zip(parts, routing, strict=True)])
    return Node(np.linalg.norm(routing - centre, axis=1), routing, radii, children)


def build(ids: np.ndarray, rows: np.ndarray, r2: float, pivot: np.ndarray) -> Subtree:
    """The subtree of some rows below the routing vector ``pivot`` (lifted)."""
    points, order = lifted(rows, r2), []
    root = _pages(points, np.arange(len(ids)), pivot, order, 0)
    place = np.concatenate(order)
    return Subtree(ids[place], rows[place], root, float(np.linalg.norm(points - pivot, axis=1).max()))


@dataclass
class Best:
    """The k best of each query so far, best first; unused places have the id ``_NONE``."""

    scores: np.ndarray  # queries x k
    ids: np.ndarray

    @classmethod
    def none(cls, queries: int, k: int, dtype: type) -> Best:
        least = -np.inf if dtype is float else np.iinfo(np.int64).min
        return cls(np.full((queries, k), least, dtype=dtype), np.full((queries, k), _NONE, dtype=np.int64))

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Takes candidates in; returns the queries whose list changed."""
        worst, last = self.scores[which, -1][:, None], self.ids[which, -1][:, None]
        better = use & ((scores > worst) | ((scores == worst) & (ids[None] < last)))
        some = np.flatnonzero(better.any(axis=1))
        if len(some):
            k, rows = self.scores.shape[1], which[some]
            least = self.scores.dtype.type(-np.inf if self.scores.dtype.kind == "f" else np.iinfo(np.int64).min)
            s = np.concatenate([self.scores[rows], np.where(better[some], scores[some], least)], axis=1)
            i = np.concatenate([self.ids[rows], np.where(better[some], ids[None], _NONE)], axis=1)
            top = np.lexsort((i, -s if s.dtype.kind == "f" else ~s), axis=1)[:, :k]
            self.scores[rows], self.ids[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        return which[some]


def search(tree: Subtree, pivot: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, r2: float, k: int, kth: np.ndarray | None = None, count: list[int] | None = None) -> Best:
    """The k best rows of the subtree for each query, but for its own id.

    ``kth`` is a score that a row must reach to matter, per query (``-inf``: any).  ``count`` gathers the scores computed.
    """
    n = len(queries)
    top = max(float(np.abs(tree.rows).max(initial=0)), 1.0) * max(float(np.abs(queries).max(initial=0)), 1.0) * queries.shape[1]
    if top >= 2**62:
        raise OverflowError("inner products exceed 62 bits")
    exact = float if top < 2**53 else np.int64  # sums of floats are exact as far as this
    q, rows = queries.astype(exact), tree.rows.astype(exact)
    points = np.column_stack([queries.astype(float), np.zeros(n)])
    reach2 = (points**2).sum(axis=1) + r2
    slack = 1e-7 * (1 + np.sqrt(reach2))
    within = lambda score: np.sqrt(np.maximum(0.0, reach2 - 2.0 * score)) + slack
    limit = within(kth) if kth is not None else np.full(n, np.inf)
    best = Best.none(n, k, exact)
    to_pivot = distances(points, pivot[None])[:, 0]
    heap: list[tuple[float, int, Node, np.ndarray, np.ndarray]] = [(0.0, 0, tree.root, to_pivot, np.maximum(0.0, to_pivot - tree.radius))]
    pushed = 0
    while heap:
        least, _, node, from_parent, low = heapq.heappop(heap)
        if least > limit.max(initial=0.0):
            break
        active = np.flatnonzero(low <= limit)
        if not len(active):
            continue
        reach = 0.0 if node.radii is None else node.radii[None]
        use = np.abs(from_parent[active][:, None] - node.parent_distance[None]) - reach <= limit[active][:, None]
        cols = np.flatnonzero(use.any(axis=0))
        if not len(cols):
            continue
        use = use[:, cols]
        if node.children is None:
            ids = tree.ids[node.rows[0] + cols]
            if count is not None:
                count[0] += use.sum()
            use &= ids[None] != query_ids[active][:, None]
            changed = best.add(active, q[active] @ rows[node.rows[0] + cols].T, ids, use)
            full = changed[best.ids[changed, -1] != _NONE]
            limit[full] = np.minimum(limit[full], within(best.scores[:, -1].astype(float))[full])
            continue
        d = distances(points[active], node.vectors[cols])
        below = np.where(use, np.maximum(0.0, d - node.radii[cols][None]), np.inf)
        for j, c in enumerate(cols):
            if (below[:, j] <= limit[active]).any():
                away, at_least = np.zeros(n), np.full(n, np.inf)
                away[active], at_least[active] = d[:, j], below[:, j]
                pushed += 1
                heapq.heappush(heap, (float(below[:, j].min()), pushed, node.children[c], away, at_least))
    return best


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _one_row_an_id(rows: DataFrame) -> DataFrame:
    again = cut(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    if again.isEmpty():
        drop_cut(again)
        return rows
    least = rows.join(again, "id", "left_semi").groupBy("id").agg(F.max("q").alias("q"), F.min("v").alias("v"))
    return rows.join(again, "id", "left_anti").select("id", "q", "v").unionByName(least)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int = 8192, block_queries: int = 2048, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, id, score`` for the rows where ``is_query`` holds, against all other rows.

    A subtree has about ``block_rows`` rows, or more where there would be over ``MOST_SUBTREES``; a
    task searches one subtree for about ``block_queries`` queries at most.  The driver holds the top
    page and a few numbers per subtree.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    whole = vectors.where(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )
    whole = cut(_one_row_an_id(whole), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = whole.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.coalesce(F.max(square), F.lit(0.0)).alias("r2")).first()
    width, r2 = stats.width, stats.r2
    block_rows = max(block_rows, -(-stats.n // MOST_SUBTREES))
    sample = whole.orderBy(F.xxhash64("id"), "id").limit(max(1, min(MOST_PIVOTS, -(-stats.n // block_rows)))).select("v").collect()
    pivots = lifted(matrix([r.v for r in sample], width), r2)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = distances(lifted(matrix(batch.column(2).to_pylist(), width), r2), pivots).argmin(axis=1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "q", "v", "cell"])

    celled = cut(whole.mapInArrow(nearest, "id long, q boolean, v array<long>, cell int"), "cells")
    drop_cut(whole)
    counts = {r.cell: r.n for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    first = np.cumsum([0] + [-(-counts.get(c, 0) // block_rows) for c in range(len(pivots))])
    number = lambda xs: F.array(*(F.lit(int(x)) for x in xs))
    shares = F.get(number(np.diff(first)), F.col("cell"))
    placed = celled.withColumn("tree", (F.get(number(first[:-1]), F.col("cell")) + F.pmod(F.xxhash64("id"), shares)).cast("int"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build(pdf.id.to_numpy(), matrix(list(pdf.v), width), r2, pivots[pdf.cell.iloc[0]])
        return pd.DataFrame({"tree": [pdf.tree.iloc[0]], "cell": [pdf.cell.iloc[0]], "radius": [made.radius], "pages": [pickle.dumps(made, protocol=5)]})

    trees = cut(placed.groupBy("tree").applyInPandas(grow, "tree int, cell int, radius double, pages binary"), "trees")

    def find(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(own):
            tree, q = pickle.loads(own.pages.iloc[0]), matrix(list(queries.v), width)
            got = search(tree, pivots[own.cell.iloc[0]], q, queries.id.to_numpy(), r2, k, queries.kth.to_numpy(dtype=float))
            for i, ids, scores in zip(queries.id, got.ids, got.scores, strict=True):
                there = ids != _NONE
                out.append((i, ids[there].tolist(), [int(s) for s in scores[there]]))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    found = "query_id long, ids array<long>, scores array<long>"
    queries = placed.where("q").select("id", "v", "tree", F.lit(float("-inf")).alias("kth"))
    home = cut(queries.groupBy("tree").cogroup(trees.groupBy("tree")).applyInPandas(find, found), "home")

    radii = {r.tree: (r.cell, r.radius) for r in trees.select("tree", "cell", "radius").collect()}
    cell_of, radius_of = (np.array([radii[t][j] for t in sorted(radii)]) for j in (0, 1))
    tree_of = np.array(sorted(radii))

    step = max(1, ROUTED // max(1, len(tree_of)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The subtrees other than its own that can hold a better row, per query."""
        for batch in batches:
            if not batch.num_rows:
                continue
            q, kth = lifted(matrix(batch.column(1).to_pylist(), width), 0.0), batch.column(2).to_numpy(zero_copy_only=False)
            reach2 = (q**2).sum(axis=1) + r2
            limit = np.sqrt(np.maximum(0.0, reach2 - 2.0 * kth)) + 1e-7 * (1 + np.sqrt(reach2))
            own, lists = batch.column(3).to_numpy(), []
            for i in range(0, len(q), step):  # a few queries at a time: queries x subtrees stays small
                some = slice(i, i + step)
                may = distances(q[some], pivots)[:, cell_of] - radius_of[None] <= limit[some, None]
                may &= tree_of[None] != own[some, None]
                lists += [tree_of[m] for m in may]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lists, pa.list_(pa.int32()))], names=["id", "v", "kth", "trees"])

    kth = F.when(F.size("scores") >= k, F.element_at("scores", -1).cast("double")).otherwise(float("-inf"))
    bound = queries.drop("kth").join(home.select(F.col("query_id").alias("id"), kth.alias("kth")), "id")
    n_queries = home.count()
    turn = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_queries // block_queries)))).cast("int")
    routed = bound.select("id", "v", "kth", "tree").mapInArrow(route, "id long, v array<long>, kth double, trees array<int>")
    routed = cut(routed.withColumn("turn", turn), "routed")
    sent = routed.select("id", "v", "kth", "turn", F.explode("trees").alias("tree"))
    # A subtree goes to the turns that some query of was routed to it, and to no other.
    asked = sent.select("tree", "turn").distinct().groupBy("tree").agg(F.collect_list("turn").alias("turns"))
    again = trees.join(asked, "tree").withColumn("turn", F.explode("turns")).drop("turns")
    more = sent.groupBy("tree", "turn").cogroup(again.groupBy("tree", "turn")).applyInPandas(find, found)
    every = home.union(more).select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score"))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return every.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
