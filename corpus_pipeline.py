"""From raw documents to token ids: toxicity, language, near-duplicates, mixing, byte-level BPE.

Each stage takes all documents that its predecessor kept and returns the columns of
``documents``; the last returns token ids and digests.  Between stages the documents are
written and read again, so every stage is planned from plain files and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, hyperminhash, language, mixing, toxicity
from ledgerloom.llm.common import cut, drop_cut, keep, table, temporaries
from ledgerloom.llm.queries import TOXIC_AT, tokenizer_files

#: Documents whose language is less certain than this go, as do those without letters.
LEAST_LANGUAGE_SCORE = 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the labelled examples call toxic (score of ``TOXIC_AT`` or more)."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).where(F.col("tox_score") < TOXIC_AT).select(docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language: without letters, or too uncertain; none if no language can be learnt."""
    model = language.fit(docs.select("doc_id", "text", "lang"))
    if model.net is None:
        return docs
    found = language.predict(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def one_row_per_text(docs: DataFrame) -> DataFrame:
    """Adds ``_node``, a number for every document, to the rows that remain.

    Of rows that share id and text the least remains.  The least text of an id has the id for its
    number, other texts of that id have numbers above all ids, in the order of id and text; rows
    without id have none.
    """
    repeated = keep(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return docs.withColumn("_node", F.col("doc_id"))
    texts = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    texts = cut(texts, "repeated")
    first = texts.groupBy("doc_id").agg(F.min(F.struct("text")).alias("first"))
    texts = texts.join(first, "doc_id").withColumn("_first", F.col("text").eqNullSafe(F.col("first.text")))
    top = docs.agg(F.max("doc_id").alias("top")).first().top
    more = texts.where("NOT _first").orderBy("doc_id", "text").withColumn("_node", F.monotonically_increasing_id() + F.lit(top + 1))
    numbered = texts.where("_first").withColumn("_node", F.col("doc_id")).unionByName(more).select(*docs.columns, "_node")
    return docs.join(repeated, "doc_id", "left_anti").select(docs.columns).withColumn("_node", F.col("doc_id")).unionByName(cut(numbered, "numbered"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (five-word shingles, similarity 0.8).

    Different texts of one id are documents of their own (see :func:`one_row_per_text`).
    """
    rows = one_row_per_text(docs)
    groups = cut(hyperminhash.near_duplicates(rows.select(F.col("_node").alias("doc_id"), "text"), words=5, percent=80), "groups")
    gone = keep(groups.where("id != root").select(F.col("id").alias("_node")).distinct())
    if gone.count() <= hyperminhash.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, "_node", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources reach their target weights."""
    sources = F.array("source")
    mix = mixing.solve(docs, sources, F.col("doc_id"), F.col("text"))
    mixed = mixing.copies(docs, mix, sources, F.col("doc_id"), name="_copies").where("_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, packed, with the digests of ids and of the decoded bytes."""
    path, pattern = tokenizer_files()
    return byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, decoded=True).select(
        "doc_id", "lang", "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.col("packed").alias("ids"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", to_tokens),
]

#: Learned scores and a tokenizer cannot be written in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage wrote for itself goes when its result is written."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporaries() as kept:
            after = cut(stage(spark, docs, sf_dir), name)
            kept.append(after)
        if docs is not before:
            drop_cut(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
