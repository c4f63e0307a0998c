"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources at once.  Documents with the same set of sources form
one pattern; patterns and their sizes are aggregated on the executors (partial sums first, so a
hot source is no bottleneck).  On the driver a flow network routes token capacity

    start -> pattern (one arc per repetition, dearer each time) -> each of its sources -> end

where the arc into the end holds a source's quota.  The repetition costs 1, 3, 5, ... are
convex, so a cheapest maximal flow fills first readings everywhere before it repeats anything.
The flow through a pattern is then turned into documents: every document is taken as often as
full readings go, and a seeded order (the md5 of seed and id) decides who is taken once more.
The cut in that order is found from 4096 hash ranges per pattern, then from 4096 parts of one of
them, and only then among rows, so no task ever sorts a whole source (at 10^11 documents of one
source some 6,000 rows are left).

Driver memory: one number per pattern and source.  ``max_patterns`` bounds and checks it.

Defined results: a null or empty text has size 0 and is taken 0 words; a document without any
source is taken 0 times; a null source is a source of its own, last in order; rows with equal
ids share their hash and are taken alike; reruns agree; an empty table gives an empty mix; a
column named like the new one (``copies``) is replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, n_words

#: The cut is found from 4096 parts of the order, each cut into 4096 again so often.
REFINED = 2


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares ``total`` by weight; a share stops at ``most`` times its size, the rest is shared anew."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while free and left > 0:
        w = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class FlowNetwork:
    """Min-cost max-flow by the primal-dual method, in integers.

    For every distinct cost of a cheapest path, one pass of shortest distances gives the node
    prices, and blocking flows fill all paths of that cost at once.  Repetitions cost 1, 3, ..., so
    there are few such costs, however many patterns there are.
    """

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> _Arc:
        there, here = _Arc(b, room, cost, len(self.arcs[b])), _Arc(a, 0, -cost, len(self.arcs[a]))
        self.arcs[a].append(there)
        self.arcs[b].append(here)
        return there

    def run(self, start: int, end: int) -> int:
        price, sent = [0] * len(self.arcs), 0
        while self._reprice(start, end, price):
            while more := self._block(start, end, price):
                sent += more
        return sent

    def _reprice(self, start: int, end: int, price: list[int]) -> bool:
        """Adds shortest distances under reduced costs to the prices; false if the end is out of reach."""
        far = float("inf")
        dist: list[float] = [far] * len(self.arcs)
        dist[start], heap = 0, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for arc in self.arcs[u]:
                if arc.room > 0 and (to := d + arc.cost + price[u] - price[arc.to]) < dist[arc.to]:
                    dist[arc.to] = to
                    heapq.heappush(heap, (to, arc.to))
        if dist[end] == far:
            return False
        for v, d in enumerate(dist):
            price[v] += int(min(d, dist[end]))
        return True

    def _block(self, start: int, end: int, price: list[int]) -> int:
        """A blocking flow over the arcs of no reduced cost, level by level; 0 if none is left."""
        level = [-1] * len(self.arcs)
        level[start], queue = 0, [start]
        for u in queue:
            for arc in self.arcs[u]:
                if arc.room > 0 and level[arc.to] < 0 and arc.cost + price[u] == price[arc.to]:
                    level[arc.to] = level[u] + 1
                    queue.append(arc.to)
        if level[end] < 0:
            return 0
        at, path, sent, u = [0] * len(self.arcs), [], 0, start
        while True:
            if u == end:
                amount = min(a.room for a in path)
                for a in path:
                    a.room -= amount
                    self.arcs[a.to][a.back].room += amount
                sent += amount
                del path[next(i for i, a in enumerate(path) if not a.room) :]
            else:
                arcs = self.arcs[u]
                while at[u] < len(arcs):
                    a = arcs[at[u]]
                    if a.room > 0 and level[a.to] == level[u] + 1 and a.cost + price[u] == price[a.to]:
                        break
                    at[u] += 1
                if at[u] < len(arcs):
                    path.append(arcs[at[u]])
                elif path:
                    path.pop()
                    at[path[-1].to if path else start] += 1
                else:
                    return sent
            u = path[-1].to if path else start


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], repeats: int = 2) -> list[int]:
    """Tokens to take from each pattern (its source numbers, its size), up to ``repeats`` readings."""
    first, sources = 2, 2 + len(patterns)
    net = FlowNetwork(sources + len(quotas))
    taken = []
    for p, (members, size) in enumerate(patterns):
        taken.append([net.add(0, first + p, size, 2 * r + 1) for r in range(repeats)])
        for s in members:
            net.add(first + p, sources + s, repeats * size, 0)
    for s, quota in enumerate(quotas):
        net.add(sources + s, 1, quota, 0)
    net.run(0, 1)
    return [sum(size - a.room for a in arcs) for (_, size), arcs in zip(patterns, taken, strict=True)]


def _pattern(sources: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(sources)))


@dataclass
class Mix:
    """A solved mix: one row per pattern, small enough to broadcast (``max_patterns`` rows)."""

    plan: DataFrame  # pattern, full (readings of every document), last (greatest hash of one more)
    totals: DataFrame  # source, source_size, target


def solve(
    docs: DataFrame,
    sources: Column,
    doc_id: Column,
    text: Column,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    max_patterns: int = 100_000,
) -> Mix:
    """Solves the mix over all documents.

    Sources in code-point order (null last) weigh ``weights``, repeating; together they get
    ``share`` times all sizes, each at most ``most`` times its own.
    """
    spark = docs.sparkSession
    sized = cut(docs.select(_pattern(sources).alias("pattern"), F.array_distinct(sources).alias("members"), n_words(text).alias("size"), order_key(doc_id, seed).alias("h")), "mix-sizes")
    groups = (
        sized.where(F.size("members") > 0)
        .groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size"))
    )
    rows = sorted(groups.limit(max_patterns + 1).collect(), key=lambda r: r.pattern)
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    names = sorted({m for r in rows for m in r.members}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in rows:
        for m in set(r.members):
            sizes[number[m]] += r.size
    total = share * sum(r.size for r in rows)
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(names))], total, most)
    repeats = int(-(-most // 1))
    flow = route([([number[m] for m in set(r.members)], r.size) for r in rows], [round(t) for t in targets], repeats)
    need = [(r.pattern, f // r.size if r.size else 0, f % r.size if r.size else 0) for r, f in zip(rows, flow, strict=True)]
    # Who is taken once more: the place of the cut, three digits of the hash at a time, then within the rows left.
    place = "pattern string, prefix string, before long, more long"
    edges = spark.createDataFrame([(p, "", 0, more) for p, _, more in need if more], place)
    for digits in range(3, 3 * REFINED + 1, 3):
        inside = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = (
            sized.join(F.broadcast(edges), "pattern").where(F.startswith("h", "prefix"))
            .groupBy("pattern", "before", "more", F.substring("h", 1, digits).alias("part")).agg(F.sum("size").alias("size"))
            .withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .where((F.col("before") <= F.col("more")) & (F.col("more") < F.col("before") + F.col("size")))
        )
        edges = spark.createDataFrame(parts.select("pattern", F.col("part").alias("prefix"), "before", "more").collect(), place)  # a row a pattern at most
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("h"))  # equal hashes count together
    last = (
        sized.join(F.broadcast(edges), "pattern").where(F.startswith("h", "prefix"))
        .groupBy("pattern", "before", "more", "h").agg(F.sum("size").alias("size"))
        .withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("more"))
        .groupBy("pattern").agg(F.max("h").alias("last"))
    )
    # Hashes before the prefix are all taken; of those that begin with it, up to ``last``; "" takes no one.
    cuts = {r.pattern: r.prefix for r in edges.collect()} | {r.pattern: r.last for r in last.collect()}
    drop_cut(sized)
    plan = [(p, full, cuts.get(p, "")) for p, full, _ in need]
    totals = spark.createDataFrame([(s, sizes[i], float(targets[i])) for s, i in number.items()], "source string, source_size long, target double")
    return Mix(spark.createDataFrame(plan, "pattern string, full int, last string"), totals)


def order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def copies(docs: DataFrame, mix: Mix, sources: Column, doc_id: Column, seed: int = 7, name: str = "copies") -> DataFrame:
    """Adds ``name``: how often the mix reads each document.  Joins one row per pattern by broadcast."""
    free = "_mix"
    while any(c.startswith(free) for c in docs.columns):
        free = "_" + free
    plan = mix.plan.select(F.col("pattern").alias(f"{free}_pattern"), F.col("full").alias(f"{free}_full"), F.col("last").alias(f"{free}_last"))
    return (
        docs.withColumn(f"{free}_pattern", _pattern(sources))
        .join(F.broadcast(plan), f"{free}_pattern", "left")
        .withColumn(name, F.coalesce(F.col(f"{free}_full") + (order_key(doc_id, seed) <= F.col(f"{free}_last")).cast("int"), F.lit(0)))
        .drop(f"{free}_pattern", f"{free}_full", f"{free}_last")
    )
