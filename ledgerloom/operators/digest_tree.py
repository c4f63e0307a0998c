"""A stored tree of digests over the documents of a release, and the difference of two releases.

Level 0 holds a digest per document, every level above one per 4,096 neighbours, up to a level of at
most sixteen nodes; a node's place depends on the document's id alone, so trees of different releases can be
laid over one another.  A comparison starts at the top and looks below a node only if the two
releases differ there: equal parts are never read, and what it reads grows with the differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bus

BITS = 12
LEVELS = 6  # 64-bit ids
NODE = "at long, h string, n long"

#: Nodes of which the children are asked for by ranges that reach the scan; more are joined.
RANGES = 100


def store(outcomes: DataFrame, path: str, key: str = "doc_id", pos: str = "pos") -> None:
    """Writes the tree, each level from the one below it as it was written, in the order of its nodes."""
    spark = outcomes.sparkSession
    level = bus.outcome_set(outcomes, key, pos).select(F.col(key).cast("long").alias("at"), F.col("outcome_set_id").alias("h"), F.lit(1).cast("long").alias("n"))
    for i in range(LEVELS):
        place = f"{path}/level={i}"
        level.repartitionByRange("at").sortWithinPartitions("at").write.parquet(place)
        level = spark.read.schema(NODE).parquet(place)
        rows = F.array_sort(F.collect_list(F.struct("at", "h")))
        joined = F.array_join(F.transform(rows, lambda r: F.concat(r["at"].cast("string"), F.lit(":"), r["h"])), "\n")
        level = level.groupBy(F.shiftright("at", BITS).alias("up")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n")).select(F.col("up").alias("at"), "h", "n")


def difference(spark: SparkSession, before: str, after: str) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, change`` (added, removed or changed) between two stored trees, and the nodes compared per level."""
    read = lambda path, i: spark.read.schema(NODE).parquet(f"{path}/level={i}").select("at", "h")
    differs: DataFrame | None = None
    scanned: dict[int, int] = {}
    for i in reversed(range(LEVELS)):
        a, b = read(before, i), read(after, i)
        if differs is not None:
            few = [r.at for r in differs.select("at").limit(RANGES + 1).collect()]
            if not few:
                return spark.createDataFrame([], "doc_id long, change string"), scanned
            if len(few) <= RANGES:
                below = F.lit(False)
                for at in few:
                    below = below | F.col("at").between(at << BITS, (at << BITS) + (1 << BITS) - 1)
                a, b = a.where(below), b.where(below)
            else:
                ups = differs.select(F.col("at").alias("_up"))
                a, b = (x.join(ups, F.shiftright(x["at"], BITS) == F.col("_up"), "left_semi") for x in (a, b))
        both = a.withColumnRenamed("h", "_a").join(b.withColumnRenamed("h", "_b"), "at", "full_outer")
        scanned[i] = both.count()
        differs = both.where(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return differs.select(F.col("at").alias("doc_id"), change.alias("change")), scanned
