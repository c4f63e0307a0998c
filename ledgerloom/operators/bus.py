"""The review bus: lanes, blind options, findings, edits, verification, outcomes, document review.

Model calls are injected as functions over Arrow batches; what they return is written to a ledger
before it is used, because Spark may run a function again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions.values import SERIOUS

Service = Callable[[pd.DataFrame], pd.DataFrame]


class Registry:
    """Named services (name → function from a batch of requests to a batch of replies and its schema)."""

    def __init__(self) -> None:
        self._services: dict[str, tuple[Service, str]] = {}

    def add(self, name: str, schema: str) -> Callable[[Service], Service]:
        def keep(f: Service) -> Service:
            self._services[name] = (f, schema)
            return f

        return keep

    def call(self, name: str, requests: DataFrame) -> DataFrame:
        f, schema = self._services[name]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from map(f, batches)

        return requests.mapInPandas(run, schema)


def memoized(requests: DataFrame, results: DataFrame, call: Callable[[DataFrame], DataFrame], key: str = "call") -> DataFrame:
    """Stored results, and those of the requests that have none yet."""
    new = call(requests.join(results.select(key), key, "left_anti"))
    return results.join(requests.select(key), key, "left_semi").unionByName(new)


def lanes(routes: DataFrame) -> DataFrame:
    """One candidate request per unit and lane."""
    return routes.select("unit", F.posexplode("lanes").alias("lane_ordinal", "lane"))


def options(candidates: DataFrame, *carry: str) -> DataFrame:
    """Blind options: an opaque key that commits to the candidate, no provenance; ``carry``: columns of their units."""
    key = ids.digest(ids.NS_OPTION, candidate=F.col("candidate_id"), unit=F.col("unit").cast("string"))
    return candidates.select(key.alias("option_key"), "unit", "target_text", *carry)


def is_serious(findings: Column) -> Column:
    return F.exists(findings, lambda f: f["severity"].isin(*SERIOUS))


def uncited(findings: DataFrame) -> DataFrame:
    """Serious findings without a source or target span."""
    return findings.where(F.col("severity").isin(*SERIOUS) & F.col("source_span").isNull() & F.col("target_span").isNull())


def edits(adjudications: DataFrame, edited: DataFrame) -> DataFrame:
    """Edits with the derived flag ``changed``."""
    return adjudications.join(edited, "unit").withColumn("changed", ~F.col("target_text").eqNullSafe(F.col("edited_text")))


def verify(edits_: DataFrame, findings: DataFrame) -> DataFrame:
    """Verdict per unit: BLOCK if any serious finding, a degrading edit or text that was left untranslated.

    The last is a boolean column ``untranslated`` of the edits, if they have it: no service can overrule it.
    """
    kept = F.coalesce("untranslated", F.lit(False)) if "untranslated" in edits_.columns else F.lit(False)
    worst = findings.groupBy("unit").agg(F.bool_or(F.col("severity").isin(*SERIOUS)).alias("serious"), F.count("*").alias("n_findings"))
    j = edits_.join(worst, "unit", "left")
    return j.withColumn("verdict", F.when(F.coalesce("serious", F.lit(False)) | (F.col("impact") == "DEGRADES") | kept, "BLOCK").otherwise("PASS")).fillna({"n_findings": 0, "serious": False})


def outcomes(verified: DataFrame) -> DataFrame:
    return verified.where("verdict = 'PASS'")


def chunk_reports(findings: DataFrame) -> DataFrame:
    """First level of the document review: a verdict per chunk."""
    return findings.groupBy("doc_id", "chunk").agg(F.when(F.bool_or(F.col("severity").isin(*SERIOUS)), "BLOCK").otherwise("PASS").alias("verdict"), F.count("*").alias("n"))


def merge_reports(reports: DataFrame) -> DataFrame:
    """Second level: any blocking chunk blocks the document and makes a synthesis needless."""
    blocked = F.bool_or(F.col("verdict") == "BLOCK")
    return reports.groupBy("doc_id").agg(
        F.when(blocked, "BLOCK").otherwise("PASS").alias("verdict"), F.count("*").alias("n_chunks"), (~blocked & (F.count("*") > 1)).alias("needs_synthesis")
    )


def report_groups(reports: DataFrame, fan: int = 64) -> DataFrame:
    """``doc_id, part, reports`` of documents with several reports: at most ``fan`` neighbours together.

    ``reports``: ``doc_id, part, verdict, notes``, the parts of a document being 0, 1, ...
    """
    several = reports.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    own = reports.join(several, "doc_id", "left_semi").withColumn("_to", F.expr(f"int(part div {fan})"))
    grouped = own.groupBy("doc_id", F.col("_to").alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col("part").alias("at"), "verdict", "notes"))).alias("reports"))
    return grouped


def merged_findings(findings: DataFrame) -> DataFrame:
    """Findings of all chunks, each (category, severity, unit, message) once."""
    return findings.dropDuplicates(["doc_id", "category", "severity", "unit", "message"])


def outcome_set(outcomes_: DataFrame, key: str = "doc_id", pos: str = "para") -> DataFrame:
    """Digest over a document's outcomes in plan order."""
    rows = F.array_sort(F.collect_list(F.struct(pos, "outcome_id")))
    return outcomes_.groupBy(key).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("\n", F.transform(rows, lambda r: r["outcome_id"])), 256).alias("outcome_set_id"))


def release(outcomes_: DataFrame, key: str = "doc_id", pos: str = "pos", fan: int = 4096) -> dict:
    """One digest over the outcome sets of all documents in the order of their ids, and the counts.

    A tree of digests: ``fan`` neighbours at most meet in a task on every level, up to one.
    """
    ends = outcomes_.agg(F.max(key).alias("top"), F.min(key).alias("low")).first()
    level = outcome_set(outcomes_, key, pos).select((F.col(key) - F.lit(ends.low)).alias("at"), F.col("outcome_set_id").alias("h"), F.lit(1).alias("d"), "n")
    span = 1 if ends.top is None else int(ends.top) - int(ends.low) + 1
    while True:
        rows = F.array_sort(F.collect_list(F.struct("at", "h")))
        digest = F.sha2(F.concat_ws("\n", F.transform(rows, lambda r: r["h"])), 256).alias("h")
        level = level.groupBy(F.expr(f"at div {fan}").alias("g")).agg(digest, F.sum("d").alias("d"), F.sum("n").alias("n")).select(F.col("g").alias("at"), "h", "d", "n")
        span = -(-span // fan)
        if span <= 1:
            break
    top = level.first()
    return {"release_id": top.h if top else None, "documents": top.d if top else 0, "outcomes": top.n if top else 0}


def option_sets(options_: DataFrame, *others: Column) -> DataFrame:
    """Per unit its options in the order of their keys (a unit has a few lanes), and other aggregates."""
    return options_.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("option_key", "target_text"))).alias("options"), *others)


def report(options_: DataFrame, findings: DataFrame) -> DataFrame:
    """A review report per unit: options and findings in the order of their ids, and the digest of the option set."""
    opts = option_sets(options_)
    found = findings.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("finding_id", "option_key", "severity"))).alias("findings"))
    set_id = F.sha2(F.concat_ws("\n", F.transform("options", lambda o: o["option_key"])), 256)
    none = F.array().cast("array<struct<finding_id:string,option_key:string,severity:string>>")
    return opts.join(found, "unit", "left").select("unit", set_id.alias("option_set_id"), "options", F.coalesce("findings", none).alias("findings"))


def by_rules(requests: DataFrame) -> DataFrame:
    """Adjudication by rule: the first option without a serious finding, whose rivals' serious findings it avoids.

    Where every option has one, there is no selection and the text must come from a service, so the
    reply is an error.
    """
    bad = F.transform(F.filter("findings", lambda f: f["severity"].isin(*SERIOUS)), lambda f: f["option_key"])
    clean = F.filter("options", lambda o: ~F.array_contains(bad, o["option_key"]))
    chosen = F.try_element_at(clean, F.lit(1))["option_key"]
    done = F.transform(F.filter("findings", lambda f: f["severity"].isin(*SERIOUS)), lambda f: F.struct(f["finding_id"].alias("finding_id"), F.lit("AVOIDED").alias("action")))
    return requests.select(
        "call", F.lit("SELECT").alias("mode"), chosen.alias("selected"), F.lit(None).cast("string").alias("text"), done.alias("resolutions"),
        F.when(chosen.isNull(), "every option has a serious finding").alias("error"),
    )


def unit_keys(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``unit_key``, read at ``stage.context.unit_key`` of a JSON payload; null where it is malformed."""
    return payloads.withColumn("unit_key", F.nullif(F.get_json_object(payload, "$.stage.context.unit_key"), F.lit("")))


def unknown_citations(observations: DataFrame, known: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Citations of units that their chunk does not hold, and observations without any (null key).

    ``observations``: ``chunk, observation, unit_keys`` (array); ``known``: ``chunk, unit_key``.
    """
    cited = observations.select(chunk, "observation", F.explode_outer("unit_keys").alias("unit_key"))
    return cited.join(known.select(chunk, "unit_key").distinct(), [chunk, "unit_key"], "left_anti")


def adjudicate(options_: DataFrame, findings: DataFrame) -> DataFrame:
    """Per unit the first option without a serious finding (SELECT), or none (SYNTHESIZE).

    ``options_``: ``unit, option_key``; ``findings``: ``finding_id, unit, option_key, severity``.
    """
    bad = findings.where(F.col("severity").isin(*SERIOUS)).select("unit", "option_key").distinct().withColumn("_bad", F.lit(True))
    j = options_.join(bad, ["unit", "option_key"], "left")
    chosen = j.groupBy("unit").agg(F.min(F.when(F.col("_bad").isNull(), F.col("option_key"))).alias("selected"))
    return chosen.withColumn("mode", F.when(F.col("selected").isNull(), "SYNTHESIZE").otherwise("SELECT"))


def resolutions(adjudications: DataFrame, findings: DataFrame) -> DataFrame:
    """One resolution per serious finding: avoided with another option selected, else corrected."""
    j = findings.where(F.col("severity").isin(*SERIOUS)).join(adjudications, "unit")
    return j.select("finding_id", F.when((F.col("mode") == "SELECT") & (F.col("option_key") != F.col("selected")), "AVOIDED").otherwise("CORRECTED").alias("action"))
