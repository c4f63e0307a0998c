"""Documents split into paragraph records with location, disposition and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions.text import blank, normalize_text

#: Disposition and reason pairs that a record may carry.
ALLOWED = {
    "translatable": ("TEXT",),
    "safe_exclusion": ("EMPTY", "PURE_NUMERIC", "FORMULA_ONLY", "DEBUG_ARTIFACT"),
    "blocker": ("VERTICAL_TEXT_UNSUPPORTED", "UNKNOWN_COMPOSITION", "MISSING_GEOMETRY"),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line of each document: ``doc_id, lang?, para, source_text, disposition, reason``.

    A null text is one empty record.  Narrow: no shuffle.
    """
    keep = [c for c in ("lang", "source") if c in docs.columns]
    lines = docs.select(doc_id, *keep, F.posexplode(F.split(normalize_text(F.coalesce(F.col(text), F.lit(""))), "\n")).alias("para", "source_text"))
    # White space at the ends is of both classes, so nothing need be stripped.
    reason = F.when(blank(F.col("source_text")), "EMPTY").when(F.col("source_text").rlike(r"(?U)^[\d\s.,%+\-]+$"), "PURE_NUMERIC").otherwise("TEXT")
    return lines.withColumn("reason", reason).withColumn("disposition", F.when(F.col("reason") == "TEXT", "translatable").otherwise("safe_exclusion"))


def identify(records: DataFrame, snapshot: str = "snapshot-1") -> DataFrame:
    """Adds ``record_key`` (location) and ``record_revision`` (location and content)."""
    where = {"doc": F.col("doc_id").cast("string"), "para": F.col("para"), "snapshot": F.lit(snapshot)}
    return records.withColumns({
        "source_sha256": ids.sha256_text(F.col("source_text")),
        "record_key": ids.digest(ids.NS_RECORD, **where),
        "record_revision": ids.digest(ids.NS_REVISION, **where, disposition=F.col("disposition"), reason=F.col("reason"), source_sha256=ids.sha256_text(F.col("source_text"))),
    })


def manifest(records: DataFrame) -> DataFrame:
    """Per document, the digest over its record revisions in order, and counts."""
    rows = F.array_sort(F.collect_list(F.struct("para", "record_revision")))
    return records.groupBy("doc_id").agg(
        F.count("*").alias("n_records"),
        F.count_if(F.col("disposition") == "translatable").alias("n_units"),
        F.sha2(F.concat_ws("\n", F.transform(rows, lambda r: r["record_revision"])), 256).alias("manifest_sha256"),
    )


def gaps(records: DataFrame) -> DataFrame:
    """Documents whose paragraph numbers are not exactly 0 … n-1: dense-sequence check."""
    return (
        records.groupBy("doc_id")
        .agg(F.count("*").alias("n"), F.count_distinct("para").alias("k"), F.min("para").alias("lo"), F.max("para").alias("hi"))
        .where((F.col("n") != F.col("k")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1))
    )


class Divergent(ValueError):
    """Supplied data do not carry the keys that they should."""


def divergent(supplied: DataFrame, snapshot: str = "snapshot-1") -> DataFrame:
    """Records of an external source whose key or revision is not the one that their content has."""
    own = identify(supplied.drop("record_key", "record_revision", "source_sha256"), snapshot).select("doc_id", "para", F.col("record_key").alias("_key"), F.col("record_revision").alias("_rev"))
    j = supplied.join(own, ["doc_id", "para"])
    wrong = F.filter(F.array(F.when(F.col("record_key") != F.col("_key"), "key"), F.when(F.col("record_revision") != F.col("_rev"), "revision")), lambda x: x.isNotNull())
    return j.withColumn("wrong", wrong).where(F.size("wrong") > 0).select("doc_id", "para", "wrong")


def ingest(supplied: DataFrame) -> DataFrame:
    """The supplied records, in which every key is proved; raises :class:`Divergent` otherwise."""
    if bad := divergent(supplied).orderBy("doc_id", "para").limit(3).collect():
        raise Divergent("; ".join(f"document {r.doc_id}, paragraph {r.para}: {', '.join(r.wrong)}" for r in bad))
    return supplied


#: A part of the registered manifest: one JSON blob per part.
PART = "struct<part_key:string,records:array<struct<para:int,source_text:string,disposition:string,reason:string>>>"


def register(records: DataFrame, part: str) -> DataFrame:
    """``part_key, blob``: the records of each part as one JSON document, as the manifest holds them."""
    rows = F.array_sort(F.collect_list(F.struct("para", "source_text", "disposition", "reason")))
    return records.groupBy(F.col(part).cast("string").alias("part_key")).agg(rows.alias("records")).select("part_key", F.to_json(F.struct("part_key", "records")).alias("blob"))


def load_document(manifest: DataFrame, part: str) -> DataFrame:
    """The typed records of one part; raises :class:`KeyError` if the manifest does not hold it or it cannot be read."""
    found = manifest.where(F.col("part_key") == part).select(F.from_json("blob", PART).alias("d"))
    first = found.select(F.col("d.records").isNotNull().alias("ok")).limit(2).collect()
    if len(first) != 1 or not first[0].ok:
        raise KeyError(part)
    return found.select(F.inline("d.records"))


def load_part(docs: DataFrame, column: str, part: str) -> DataFrame:
    """The documents of one part; the filter reaches the scan."""
    return docs.where(F.col(column) == part)
