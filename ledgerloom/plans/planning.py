"""What a run knows about its units before it calls anything: directives, context, risks and routes.

Terminology decisions (:func:`terms.decide`) become directives: every occurrence of a term in a unit
demands a rendering, which depends on the treatment and on whether it is the first use.  Neighbouring
units under a character budget are the context.  A unit's route follows from the deterministic floor, what
a model said about its risks, protected mathematical content and how well its terms are attested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions.text import PROTECTED, risk_floor, risk_reasons
from ..operators import context, terms

DIRECTIVES = "array<struct<occurrence_key:string,source_term:string,required:string,treatment:string>>"
RISKS = "unit string, level string, reasons array<string>, seq long"


def directives(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """``unit, directives, confidences`` of the units that hold a term; in the order of their places.

    ``decisions``: ``term, form, confidence, treatment``.  Terms are literal; longer ones win, and none overlap.
    """
    found = terms.occurrences(units.select("unit", "doc_id", "pos", "source_text"), decisions.select("term"))
    used = terms.with_first_use(found.drop("source_text"), "term", ("doc_id", "pos", "s", "e")).join(decisions, "term")
    key = ids.digest(ids.NS_SPAN, unit=F.col("unit").cast("string"), term=F.col("term"), s=F.col("s"))
    required = terms.rendering(F.col("treatment"), F.col("first_use"), F.col("form"), F.col("term"))
    rows = used.select("unit", "s", key.alias("occurrence_key"), F.col("term").alias("source_term"), required.alias("required"), "treatment", "confidence")
    per = rows.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("s", "occurrence_key", "source_term", "required", "treatment"))).alias("d"), F.collect_set("confidence").alias("confidences"))
    return per.select("unit", F.transform("d", lambda d: d.dropFields("s")).cast(DIRECTIVES).alias("directives"), "confidences")


def contexts(units: DataFrame, before: int, after: int, characters: int) -> DataFrame:
    """``unit, context``: the texts before and after each translatable unit, whatever their disposition."""
    records = units.select("unit", "doc_id", "pos", "source_text", "disposition")
    windows = context.context_windows(records, "doc_id", "pos", "source_text", before, after, characters, F.col("disposition") == "translatable")
    rows = context.context_rows(windows, records, "doc_id", "pos", "source_text")
    only = lambda side: F.transform(side, lambda x: x["t"]).alias(side)
    own = rows.select("doc_id", "pos", F.struct(only("before"), only("after")).alias("context"))
    return records.select("unit", "doc_id", "pos").join(own, ["doc_id", "pos"]).select("unit", "context")


def prepare(
    units: DataFrame, decisions: DataFrame, risks: DataFrame | None = None, before: int = 4, after: int = 4, characters: int = 6000
) -> tuple[DataFrame, DataFrame]:
    """Translatable units with ``directives``, ``context`` and ``risks``, and their routes ``unit, lanes, level, reasons``.

    ``units``: ``unit, doc_id, pos, source_text, lang, disposition``; ``risks``: ``unit, level, reasons,
    seq`` as a model gave them, unknown units and levels falling away.
    """
    spark = units.sparkSession
    todo = units.where("disposition = 'translatable'")
    told = spark.createDataFrame([], RISKS) if risks is None else risks
    ruled = directives(todo, decisions)
    floors = todo.select(
        "unit", risk_floor(F.col("source_text"), F.col("lang")).alias("floor"), risk_reasons(F.col("source_text"), F.col("lang")).alias("floor_reasons"), F.col("source_text").rlike(PROTECTED).alias("has_formula")
    )
    routes = terms.route(floors, told, ruled.select("unit", F.explode("confidences").alias("confidence"))).select("unit", "lanes", F.col("risk_level").alias("level"), "reasons")
    with_all = todo.select("unit", "doc_id", "pos", "source_text", "lang").join(ruled.select("unit", "directives"), "unit", "left").join(contexts(units, before, after, characters), "unit", "left")
    with_all = with_all.join(routes.select("unit", F.col("reasons").alias("risks")), "unit").withColumn("directives", F.coalesce("directives", F.array().cast(DIRECTIVES)))
    return with_all.drop("lang"), routes
