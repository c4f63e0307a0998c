"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a session in local mode, which has no
    other machine, gets a folder of its own; any other raises.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_scopes: list[list] = []


@contextmanager
def temporaries() -> Iterator[list[DataFrame]]:
    """Gives up, at the end of the block, all tables that :func:`cut` wrote and frames that :func:`keep` kept in it.

    Frames that are put into the list it yields stay.  For callers that have consumed an operator's
    result, which reads such tables until then.
    """
    spared: list[DataFrame] = []
    _scopes.append([])
    try:
        yield spared
    finally:
        kept = {f.rsplit("/", 1)[0] for df in spared for f in df.inputFiles()}
        for made in _scopes.pop():
            if isinstance(made, DataFrame):
                made.unpersist()
            elif not any(k.endswith(made[1].rsplit("/", 1)[-1]) for k in kept):
                drop_path(*made)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so its lineage ends there.

    Unlike a local checkpoint the files outlive any executor.  Zstandard keeps them small and,
    other than the default codec, holds no direct buffers until the next full garbage collection.
    """
    path = fresh_path(df.sparkSession, label)
    if _scopes:
        _scopes[-1].append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(*frames: DataFrame) -> None:
    """Deletes the files behind frames that :func:`cut` made and nothing reads any more."""
    for df in frames:
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, f)


def keep(df: DataFrame) -> DataFrame:
    """Computes ``df`` now and keeps it on the executors' disks for several uses.

    What a lost executor held is computed again from its lineage, which stays.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    if _scopes:
        _scopes[-1].append(df)
    df.count()
    return df


def release(*frames: DataFrame) -> None:
    """Gives up frames that :func:`keep` keeps."""
    for df in frames:
        df.unpersist()


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds Arrow batches by rows, so that long texts do not pile up in a Python worker.

    The session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` is lowered and stays so, since the
    frames that operators return run under it later; a smaller value of the caller stands.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "0") or 0)
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def n_words(text: Column) -> Column:
    """Number of maximal runs of bytes other than ASCII white space; 0 for null."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    return F.coalesce(
        F.size(parts) - F.element_at(parts, 1).eqNullSafe("").cast("int")
        - ((F.size(parts) > 1) & F.element_at(parts, -1).eqNullSafe("")).cast("int"),
        F.lit(0),
    ).cast("long")
