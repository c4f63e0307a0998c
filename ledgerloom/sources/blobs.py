"""Content-addressed blobs: a table keyed by digest, written once, verified on every read.

The sink proves what is already stored under a digest and drops it (anti join); it relies on Spark's
commit protocol for atomicity; the prefix column spreads the files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def addressed(df: DataFrame, content: str = "content", suffix: str = "") -> DataFrame:
    """``sha256, size, relative_path, prefix, content`` of distinct contents; null is no blob.

    Final artifacts go to a store of their own, with a ``suffix`` to their names.
    """
    sha = F.sha2(F.col(content), 256)
    return (
        df.where(F.col(content).isNotNull())
        .select(sha.alias("sha256"), F.length(content).cast("long").alias("size"), F.col(content).alias("content"))
        .dropDuplicates(["sha256"])
        .withColumn("prefix", F.left("sha256", F.lit(2)))
        .withColumn("relative_path", F.concat(F.lit("objects/"), F.col("prefix"), F.lit("/"), F.col("sha256"), F.lit(suffix)))
    )


class Corrupt(ValueError):
    """A stored object does not have the content that its name says."""


def put(df: DataFrame, store: str, content: str = "content", suffix: str = "") -> None:
    """Appends what ``store`` does not hold yet; raises :class:`Corrupt` if it holds one of the contents damaged.

    What is there is proved, not trusted: only the objects that are put again are read.
    """
    spark, new = df.sparkSession, addressed(df, content, suffix)
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        own = get(spark, store).join(new.select("sha256", "prefix"), ["prefix", "sha256"], "left_semi")
        if bad := own.where("NOT intact").select("sha256").distinct().limit(3).collect():
            raise Corrupt(f"stored objects are damaged: {', '.join(r.sha256 for r in bad)}")
        new = new.join(spark.read.parquet(store).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").partitionBy("prefix").parquet(store)


def get(spark: SparkSession, store: str) -> DataFrame:
    """Stored blobs with ``intact``: whether size and digest still fit the content.

    Two writers at once may both store an object; the rows are equal, and :func:`once` gives each once.
    """
    return spark.read.parquet(store).withColumn("intact", (F.sha2("content", 256) == F.col("sha256")) & (F.length("content") == F.col("size")))


def once(blobs: DataFrame) -> DataFrame:
    """Each digest once, an intact row if there is one."""
    best = blobs.groupBy("sha256").agg(F.max_by(F.struct(*(c for c in blobs.columns if c != "sha256")), F.col("intact").cast("int")).alias("r"))
    return best.select("sha256", "r.*")


def lookup(spark: SparkSession, references: DataFrame, store: str) -> DataFrame:
    """Adds ``state`` to references (``sha256, size`` and others): intact, corrupt or missing in the store."""
    held = get(spark, store).groupBy("sha256").agg(F.bool_and("intact").alias("_intact"), F.max("size").alias("_size"))
    j = references.join(held, "sha256", "left")
    return j.withColumn("state", F.when(F.col("_intact").isNull(), "missing").when(F.col("_intact") & (F.col("_size") == F.col("size")), "intact").otherwise("corrupt")).drop("_intact", "_size")


def context_problems(contexts: DataFrame, states: DataFrame) -> DataFrame:
    """``context_key, problems`` of rows that bind a prepared artifact to its context.

    ``contexts``: ``context_key, project_key, part_key, payload`` (JSON with the same three keys) and
    ``sha256``; ``states``: ``sha256, state`` as :func:`lookup` gives them.
    """
    said = lambda k: F.get_json_object("payload", f"$.{k}")
    j = contexts.join(states.select("sha256", "state").distinct(), "sha256", "left")
    rules = [(~said(k).eqNullSafe(F.col(k)), k.split("_")[0]) for k in ("context_key", "project_key", "part_key")]
    rules.append((~F.col("state").eqNullSafe(F.lit("intact")), "artifact"))
    return j.select("context_key", F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in rules)), lambda x: x.isNotNull()).alias("problems"))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Names of files without content, which a scan leaves out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.globStatus(p) or [])
    every = [f for x in found for f in (fs.listStatus(x.getPath()) if x.isDirectory() else [x])]
    return [f.getPath().getName() for f in every if f.isFile() and f.getLen() == 0 and not f.getPath().getName().startswith(("_", "."))]


def file_system(path: str) -> tuple[object, str]:
    """A path as Spark names it, of which nothing is quoted: pyarrow's file system and the path in it."""
    from pyarrow import fs

    scheme, _, rest = path.rpartition("://") if "://" in path else path.partition(":") if path.startswith("file:") else ("file", ":", path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, own = rest.partition("/")
    system, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{root.rstrip('/')}/{own}"


#: Files up to this size are digested as one value, larger ones block by block.
WHOLE = 1 << 26


def digest_files(spark: SparkSession, path: str, whole: int = WHOLE, block: int = 1 << 20) -> DataFrame:
    """``name, sha256, size`` of files of any size, as a delivery manifest lists them.

    A value of a row cannot exceed 2 GiB and a worker need not hold a file: files beyond ``whole`` bytes are
    read in blocks with a running hash, one file a row and a task, by the file systems that pyarrow opens.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    small = files.where(F.col("length") <= whole).select(name, F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    if none := _empty_files(spark, path):
        small = small.unionByName(spark.createDataFrame([(x, hashlib.sha256(b"").hexdigest(), 0) for x in none], "name string, sha256 string, size long"))
    large = files.where(F.col("length") > whole).select("path", name, F.col("length").alias("size"))  # content is not read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for uri in batch.column(0).to_pylist():
                system, own = file_system(uri)
                h = hashlib.sha256()
                with system.open_input_stream(own) as f:
                    while data := f.read(block):
                        h.update(data)
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(digests, pa.string()), batch.column(2)], names=["name", "sha256", "size"])

    n = large.count()
    if not n:
        return small
    return small.unionByName(large.repartition(n, "path").mapInArrow(run, "name string, sha256 string, size long"))
