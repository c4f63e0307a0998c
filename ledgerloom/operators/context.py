"""Order-dependent operators: bounded context windows and greedy chunks, folded per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import ordered_fold


def context_windows(records: DataFrame, key: str = "doc_id", pos: str = "para", text: str = "source_text", before: int = 4, after: int = 4, budget: int = 6000, only: Column | None = None) -> DataFrame:
    """Neighbours of each record under a character budget.

    Nearest first, the preceding one at equal distance; one that does not fit is skipped and a
    farther one may still be kept.  Adds ``before`` and ``after``: arrays of positions in order.
    """
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(-before, after)
    near = F.collect_list(F.struct(F.col(pos).alias("p"), F.length(text).alias("n"))).over(w)
    ranked = F.array_sort(
        F.transform(
            F.filter(near, lambda x: x["p"] != F.col(pos)),
            lambda x: F.struct(F.abs(x["p"] - F.col(pos)).alias("d"), (x["p"] > F.col(pos)).cast("int").alias("side"), x["p"].alias("p"), x["n"].alias("n")),
        )
    )
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    folded = F.aggregate(
        ranked, start,
        lambda a, x: F.when(a["used"] + x["n"] > budget, a).otherwise(F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["kept"], F.array(x["p"])).alias("kept"))),
        lambda a: F.array_sort(a["kept"]),
    )
    out = records.withColumn("_kept", folded)
    out = out.where(only) if only is not None else out
    return out.withColumn("before", F.filter("_kept", lambda p: p < F.col(pos))).withColumn("after", F.filter("_kept", lambda p: p > F.col(pos))).drop("_kept")


def chunks(items: DataFrame, key: str = "doc_id", pos: str = "para", size: str = "n", limit: int = 40_000, carry: list[str] | None = None) -> DataFrame:
    """``key, pos, chunk`` and the columns ``carry``: greedy fill in order; a chunk is closed only when it would overflow."""

    def add(state: tuple[int, int], row: tuple) -> tuple[tuple[int, int], tuple]:
        used, chunk = state
        state = (row[0], chunk + 1) if used > 0 and used + row[0] > limit else (used + row[0], chunk)
        return state, (state[1],)

    rows = items.select(key, pos, *(carry or ()), F.col(size).cast("long").alias("_size"))
    return ordered_fold(rows, [key], [pos], ["_size"], (0, 0), add, "chunk int").drop("_size")


def oversize(items: DataFrame, size: str, limit: int) -> DataFrame:
    """Items that fit no chunk at all; chunking of whole payloads refuses them."""
    return items.where(F.col(size) > limit)


def context_rows(windows: DataFrame, records: DataFrame, key: str = "doc_id", pos: str = "para", text: str = "source_text") -> DataFrame:
    """Windows with the texts of their neighbours: ``before`` and ``after`` as arrays of (position, text)."""
    near = windows.select(key, pos, F.explode(F.concat("before", "after")).alias("p"))
    texts = near.join(records.select(key, F.col(pos).alias("p"), F.col(text).alias("t")), [key, "p"])
    both = texts.groupBy(key, pos).agg(F.array_sort(F.collect_list(F.struct("p", "t"))).alias("near"))
    out = windows.select(key, pos).join(both, [key, pos], "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<p:int,t:string>>")))
    return out.select(key, pos, F.filter("near", lambda x: x["p"] < F.col(pos)).alias("before"), F.filter("near", lambda x: x["p"] > F.col(pos)).alias("after"))
