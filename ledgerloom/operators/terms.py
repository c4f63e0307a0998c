"""Terminology: occurrences, first use, evidence confidence, selection, treatment, rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import CONVENTIONALITY, TIER_WEIGHT, rank_of


def clear_concepts(concepts: DataFrame, joined_text: Column | None = None) -> DataFrame:
    """Concepts whose exact source term has one distinct sense; the last duplicate wins.

    ``concepts``: ``source_term, sense_id, forms, seq``.  Terms with protected tokens or without a
    form other than themselves are dropped.
    """
    from ..functions.text import ANY_PROTECTED

    usable = concepts.withColumn("forms", F.array_remove("forms", F.col("source_term"))).where(~F.col("source_term").rlike(ANY_PROTECTED) & (F.size("forms") > 0) & (F.trim("source_term") != ""))
    return usable.groupBy("source_term").agg(F.count_distinct("sense_id").alias("senses"), F.max_by(F.struct("sense_id", "forms"), "seq").alias("c")).where("senses = 1").select("source_term", "c.*")


def non_overlapping(hits: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Of hits ``(rank, start, end)`` those that count, best rank first.

    Hits of one term are taken from left to right without overlap; then a hit that touches one of
    a better rank falls away.
    """
    taken, out = bytearray(size), []
    rank, upto = -1, 0
    for r, s, e in sorted(hits):
        if r == rank and s < upto:
            continue
        rank, upto = r, e
        if not any(taken[s:e]):
            taken[s:e] = b"\1" * (e - s)
            out.append((r, s, e))
    return out


def occurrences(units: DataFrame, terms: DataFrame | list[str], text: str = "source_text", max_terms: int = 1_000_000) -> DataFrame:
    """Adds ``term, s, e`` to units, a row per hit: literal, case-sensitive, longest terms first.

    One automaton over all terms reads each text once, so the number of terms does not matter.  The
    terms of a project are broadcast; more than ``max_terms`` distinct ones raise.  Narrow: no shuffle.
    """
    spark = units.sparkSession
    if isinstance(terms, DataFrame):
        rows = terms.select("term").where("term <> ''").distinct().limit(max_terms + 1).collect()
        terms = [r.term for r in rows]
    ordered = sorted(set(terms) - {""}, key=lambda t: (-len(t), t))
    if len(ordered) > max_terms:
        raise ValueError(f"more than {max_terms} terms")
    shared = spark.sparkContext.broadcast(ordered)
    kept = [f for f in units.schema.fields if f.name not in ("term", "s", "e")]
    added = T.StructType.fromDDL("term string, s int, e int").fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        names, find = shared.value, ahocorasick.Automaton()
        for i, t in enumerate(names):
            find.add_word(t, i)
        find.make_automaton()
        for batch in batches:
            place, found = [], []
            for i, t in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist() if names else ()):
                if t:
                    own = non_overlapping([(r, e + 1 - len(names[r]), e + 1) for e, r in find.iter(t)], len(t))
                    place += [i] * len(own)
                    found += own
            cols = [batch.column(batch.schema.get_field_index(f.name)).take(pa.array(place, pa.int64())) for f in kept]
            ranks, starts, ends = zip(*found, strict=True) if found else ((), (), ())
            cols += [pa.array([names[r] for r in ranks], pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), "term", "s", "e"])

    return units.select(*(f.name for f in kept)).mapInArrow(run, T.StructType([*kept, *added]))


def guidance(directives: DataFrame, terms: DataFrame, context: DataFrame) -> DataFrame:
    """Per unit its directives with their term revisions, sorted by directive id, and what is wrong.

    ``directives``: ``unit, directive_id, term_revision``; ``terms``: ``term_revision, source_term``;
    ``context``: ``unit, directive_ids`` (array).  A unit's directives are few.  ``problem`` is
    ``context`` if the ids differ from those of the context, ``term`` if a revision is unknown.
    """
    j = directives.join(terms.select("term_revision", "source_term"), "term_revision", "left")
    per = j.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("directive_id", "term_revision", "source_term"))).alias("guidance"))
    both = per.join(context.select("unit", "directive_ids"), "unit", "full_outer")
    none = F.array().cast("array<string>")
    own = F.coalesce(F.transform("guidance", lambda g: g["directive_id"]), none)
    problem = F.when(own != F.array_sort(F.coalesce("directive_ids", none)), "context").when(F.exists("guidance", lambda g: g["source_term"].isNull()), "term")
    return both.select("unit", "guidance", problem.alias("problem"))


def for_unit(directives: DataFrame, units: DataFrame) -> DataFrame:
    """The directives of some units, with the order column as it was."""
    return directives.join(units.select("unit").distinct(), "unit", "left_semi")


def evidence_for(concepts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each concept by term and sense."""
    return concepts.select("source_term", "sense_id").distinct().join(evidence, ["source_term", "sense_id"])


def with_first_use(found: DataFrame, key: str = "term", order: tuple[str, ...] = ("doc_id", "para", "s", "e")) -> DataFrame:
    """Marks the first occurrence of each term in document order.

    A minimum per term is joined back, so a frequent term is not sorted in one task.
    """
    first = found.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return found.join(first, key).withColumn("first_use", F.struct(*order) == F.col("_first")).drop("_first")


def confidence(evidence: DataFrame, by: tuple[str, ...] = ("term", "form")) -> DataFrame:
    """Evidence per candidate form: counts, rank and confidence.

    ``evidence``: by columns, ``authority, tier, stance, sense_match, domain_match, conventionality``.
    """
    good = F.col("sense_match") & F.col("domain_match")
    support, against = good & (F.col("stance") == "SUPPORTS"), good & (F.col("stance") == "CONTRADICTS")
    weight = F.lit(0)
    for tier, w in TIER_WEIGHT.items():
        weight = F.when(F.col("tier") == tier, F.lit(w)).otherwise(weight)
    out = evidence.groupBy(*by).agg(
        F.count_distinct(F.when(support, F.col("authority"))).alias("sources"),
        F.coalesce(F.bool_or(support & F.col("tier").isin("A_AUTHORITY", "B_DOMAIN")), F.lit(False)).alias("strong"),
        F.coalesce(F.bool_or(against & (F.col("tier") == "A_AUTHORITY")), F.lit(False)).alias("contradicted"),
        F.sum(F.when(support, weight).otherwise(0)).alias("evidence_rank"),
        F.max(rank_of(F.col("conventionality"), CONVENTIONALITY)).alias("_rank"),
    ).withColumn("claimed", F.get(F.array(*(F.lit(c) for c in CONVENTIONALITY)), F.col("_rank"))).drop("_rank")
    conv = F.when((F.col("sources") == 0) | F.col("claimed").isNull(), "UNATTESTED").when((F.col("sources") == 1) & (F.col("claimed") == "ESTABLISHED"), "ATTESTED").otherwise(F.col("claimed"))
    out = out.withColumn("conventionality", conv).drop("claimed")
    label = (
        F.when((F.col("sources") >= 2) & F.col("strong") & ~F.col("contradicted") & F.col("conventionality").isin("ESTABLISHED", "ATTESTED"), "VERIFIED")
        .when((F.col("sources") > 0) & (F.col("strong") | (F.col("sources") >= 2)) & ~F.col("contradicted"), "SUPPORTED")
        .when(F.col("sources") > 0, "PROVISIONAL")
        .otherwise("RETAINED_UNRESOLVED")
    )
    return out.withColumn("confidence", label)


def select_form(candidates: DataFrame, by: str = "term") -> DataFrame:
    """The chosen form per term: the reviewer's unless a more conventional one is confirmed without an override.

    ``candidates``: by column, ``form, fit, conventionality, evidence_rank, selected, override``.
    """
    rank = rank_of(F.col("conventionality"), CONVENTIONALITY)
    sel = F.col("selected") & (F.col("fit") == "CONFIRMED")
    out = candidates.withColumn("_r", rank).groupBy(by).agg(
        F.max_by("form", F.when(F.col("fit") == "CONFIRMED", F.struct("_r", "evidence_rank", "form"))).alias("best"),
        F.max(F.when(F.col("fit") == "CONFIRMED", F.col("_r"))).alias("best_rank"),
        F.max(F.when(sel, F.col("form"))).alias("own"),
        F.max(F.when(sel, F.col("_r"))).alias("own_rank"),
        F.max("override").alias("override"),
    )
    keep = F.col("own").isNotNull() & ((F.col("own_rank") >= F.col("best_rank")) | (F.coalesce(F.trim("override"), F.lit("")) != ""))
    return out.select(by, F.coalesce(F.when(keep, F.col("own")), F.when(F.col("best_rank").isNotNull(), F.col("best")), F.col(by)).alias("form"))


def treatment(confidence: Column) -> Column:
    return F.when(confidence == "VERIFIED", "TRANSLATE_ONLY").when(confidence.isin("SUPPORTED", "PROVISIONAL"), "TRANSLATE_WITH_SOURCE_FIRST").otherwise("RETAIN_SOURCE")


def rendering(treatment: Column, first_use: Column, form: Column, source: Column) -> Column:
    """Required target text of an occurrence; the source stands in full-width parentheses."""
    both = F.concat(form, F.lit("（"), source, F.lit("）"))
    return (
        F.when(treatment == "RETAIN_SOURCE", source).when(treatment == "TRANSLATE_WITH_SOURCE_ALWAYS", both)
        .when((treatment == "TRANSLATE_WITH_SOURCE_FIRST") & first_use, both).otherwise(form)
    )


def last_assessments(assessments: DataFrame, materials: DataFrame) -> DataFrame:
    """Assessments with their material by (form, source_key); the last material of a key wins."""
    latest = materials.groupBy("form", "source_key").agg(F.max_by("uri", "seq").alias("uri"), F.max_by("tier", "seq").alias("tier"))
    return assessments.join(latest, ["form", "source_key"])


def route(units: DataFrame, risks: DataFrame, governed: DataFrame) -> DataFrame:
    """Risk level, lanes and sorted reasons per unit.

    ``units``: ``unit, floor, floor_reasons, has_formula``; ``risks``: ``unit, level, reasons, seq``
    (last row wins, unknown levels and units are dropped); ``governed``: ``unit, confidence``.
    """
    from ..functions.values import RISKS

    model = risks.where(F.col("level").isin(*RISKS)).groupBy("unit").agg(F.max_by(F.struct("level", "reasons"), "seq").alias("m"))
    terms = governed.groupBy("unit").agg(F.bool_or(F.col("confidence").isin("PROVISIONAL", "RETAINED_UNRESOLVED")).alias("open"))
    r = lambda c: rank_of(c, RISKS, 1)
    j = units.join(model, "unit", "left").join(terms, "unit", "left")
    level = F.coalesce(r(F.col("m.level")), F.lit(1))
    raised = F.greatest(level, r(F.col("floor")))
    some = lambda cond, text: F.when(cond, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    formula = F.when(F.col("has_formula"), F.lit(3)).otherwise(raised)
    ruled = F.col("open").isNotNull()
    final = F.when(F.coalesce(F.col("open"), F.lit(False)), F.lit(3)).when(ruled & (formula < 2), F.lit(2)).otherwise(formula)
    reasons = F.concat(
        F.coalesce(F.col("m.reasons"), none),
        F.when(r(F.col("floor")) >= raised, F.col("floor_reasons")).otherwise(none),
        some(F.col("has_formula"), "protected mathematical content"),
        some(ruled & (formula < 2), "evidence-governed terminology"),
        some(F.col("open"), "unresolved or provisional terminology"),
    )
    clean = F.array_sort(F.array_distinct(F.filter(reasons, lambda x: F.trim(x) != "")))
    out = j.withColumn("risk", final).withColumn("reasons", F.when((F.col("risk") > 1) & (F.size(clean) == 0), F.array(F.lit("model-identified semantic risk"))).otherwise(clean))
    lanes = F.when(F.col("risk") == 1, F.array(F.lit("baseline"))).otherwise(F.array(F.lit("baseline"), F.lit("alternative")))
    return out.select("unit", F.concat(F.lit("R"), F.col("risk").cast("string")).alias("risk_level"), lanes.alias("lanes"), "reasons")


def decide(evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """One decision per term: evidence per form, the reviewer's fit, the selected form and its treatment.

    ``reviews``: ``term, form, fit, selected, override``.  The source term itself is always a
    candidate and stays where nothing is confirmed.
    """
    rated = confidence(evidence).join(reviews, ["term", "form"])
    form = select_form(rated)
    label = rated.select("term", "form", "confidence")
    out = form.join(label, ["term", "form"], "left").withColumn("confidence", F.coalesce("confidence", F.lit("RETAINED_UNRESOLVED")))
    return out.withColumn("treatment", treatment(F.col("confidence")))


def evidence_problems(fit: Column, support: Column, uri: Column) -> Column:
    """A confirmed form needs qualified support, every evidence row an http(s) or urn address."""
    from .constraints import broken

    return broken(((fit == "CONFIRMED") & (support < 1), "unsupported"), (~F.coalesce(uri.rlike(r"^(https?://|urn:)\S+"), F.lit(False)), "uri"))
