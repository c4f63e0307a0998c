"""From documents to a verified text: plan, run the review bus, render, verify, publish.

Two passes.  The first renders with the approvals of the active release, if there is one; a unit
without approval only means that the run must make it.  After the run the text is rendered again
unless the release is the one just rendered, and the approvals that were used are proved against
the release once more.  Gates over the finished text decide whether it becomes the active artifact;
the report is kept either way.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import risk_floor
from ..operators import bus, constraints, gates
from ..operators.executor import Executor
from ..sources import records
from ..sources.commits import CommitLog, Transaction
from ..streaming.folders import cut, drop_cut, shuffles_dropped
from . import planning
from .kernel import Blocked, Kernel, Services
from .project import Config, Project


class MissingApprovals(RuntimeError):
    """Some unit has no approved text."""


@dataclass(frozen=True)
class Result:
    """What a run published, and whether the first pass found all approvals."""

    release: dict
    report: dict
    text: DataFrame
    capture_needed: bool


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text, lang`` of a bound source: a Parquet table of documents, or one text file as one document."""
    if str(path).endswith(".parquet"):
        return spark.read.parquet(f"file://{path}").select("doc_id", "text", "lang")
    return spark.createDataFrame([(0, Path(path).read_text(encoding="utf-8"), "en")], "doc_id long, text string, lang string")


def units_of(documents: DataFrame) -> DataFrame:
    """Paragraph records with ``unit`` (document and paragraph as one key) and position."""
    r = records.segment(documents)
    return r.withColumns({"unit": F.concat_ws(":", "doc_id", "para"), "pos": F.col("para")})


def units_table(documents: DataFrame) -> DataFrame:
    """:func:`units_of`, written once (``drop_cut`` deletes it); the documents are dealt out before, since a table of few files is few tasks."""
    with shuffles_dropped(documents.sparkSession):
        return cut(units_of(documents.repartition("doc_id")), "units")


def routes_of(units: DataFrame) -> DataFrame:
    """One lane for plain units, two for those with a raised risk floor."""
    risky = risk_floor(F.col("source_text"), F.col("lang")) != "R1"
    lanes = F.when(risky, F.array(F.lit("baseline"), F.lit("alternative"))).otherwise(F.array(F.lit("baseline")))
    return units.select("unit", lanes.alias("lanes"))


def render(units: DataFrame, approvals: DataFrame) -> DataFrame:
    """``doc_id, text``: paragraphs in order, translatable ones by their approved text; raises if one is missing."""
    own = units.join(approvals.select("unit", "edited_text"), "unit", "left")
    given = approvals.select("unit", F.col("edited_text").isNotNull().alias("given"))  # no text is dealt out for the question
    if units.where("disposition = 'translatable'").select("unit").join(given, "unit", "left").where("NOT coalesce(given, false)").limit(1).count():
        raise MissingApprovals("a unit has no approved text")
    line = F.when(F.col("disposition") == "translatable", F.col("edited_text")).otherwise(F.col("source_text"))
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("t"))))
    return own.groupBy("doc_id").agg(F.concat_ws("\n", F.transform(rows, lambda r: r["t"])).alias("text"))


def findings(units: DataFrame, outcomes: DataFrame, text: DataFrame) -> DataFrame:
    """Findings of the finished text: approved text that is absent, anchors of the source that are gone, blank documents, documents that are missing, added or there twice."""
    pages = text.select(F.col("doc_id").alias("page"), F.col("text").alias("page_text"))
    lost = gates.missing_literals(outcomes.select("unit", F.col("doc_id").alias("page"), F.col("edited_text").alias("text")), pages)
    lost = lost.join(outcomes.select("unit", "doc_id"), "unit").select("doc_id", F.lit("TEXT_COVERAGE").alias("category"), F.lit("BLOCKING").alias("severity"))
    whole = units.groupBy("doc_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_text"))), lambda r: r["source_text"])).alias("text"))
    gone = gates.missing_anchors(whole.withColumnRenamed("doc_id", "page"), text.select(F.col("doc_id").alias("page"), "text"))
    gone = gone.select(F.col("page").alias("doc_id"), F.lit("ANCHOR_COVERAGE").alias("category"), F.lit("BLOCKING").alias("severity"))
    shown, made = whole.select("doc_id", (F.trim("text") != "").alias("shown")), text.select("doc_id", (F.trim("text") != "").alias("made"))
    blank = shown.join(made, "doc_id", "left").where("shown AND NOT coalesce(made, false)").select("doc_id", F.lit("BLANK_PAGE").alias("category"), F.lit("BLOCKING").alias("severity"))
    counts = gates.page_count_findings(units.select("doc_id").distinct(), text.select("doc_id"), "doc_id").select("doc_id", "category", "severity")
    return lost.unionByName(gone).unionByName(blank).unionByName(counts)


@dataclass(frozen=True)
class Points:
    """Where a run may be extended: how units are routed, rendered and checked."""

    plan: Callable[[DataFrame], DataFrame] = routes_of  # units → unit, lanes
    render: Callable[[DataFrame, DataFrame], DataFrame] = render  # units, approvals → doc_id, text
    verify: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = findings  # units, approvals, text → doc_id, category, severity


def wire(
    spark: SparkSession, folder: str, project: Project, config: Config, services: Services, points: Points = Points(), decisions: DataFrame | None = None, risks: DataFrame | None = None
) -> Publication:
    """A publication under a project's limits: budget, attempts, lease and the size of review chunks."""
    executor = Executor(
        spark, f"{folder.rstrip('/')}/calls", owner="review-bus", max_attempts=config.max_attempts, lease_seconds=max(300, config.request_timeout_seconds + 60),
        max_calls=config.max_calls, max_cost=config.max_cost,
    )
    return Publication(spark, folder, project, services, executor, config.chunk_characters, points, config.target_language, True, decisions, risks, (config.context_before, config.context_after, config.context_characters))


class Publication:
    """``folder``: shared folder of the run's tables; ``project``: bound inputs, pointers and reports.

    With ``decisions`` about terms (``term, form, confidence, treatment``) a run is planned: its services
    read directives, context and risks, and its texts must hold what the directives demand.
    """

    def __init__(self, spark: SparkSession, folder: str, project: Project, services: Services, executor: Executor | None = None, chunk_characters: int = 40_000, points: Points = Points(), target_language: str | None = None, citations: bool = False, decisions: DataFrame | None = None, risks: DataFrame | None = None, window: tuple[int, int, int] = (4, 4, 6000)):
        self.spark, self.folder, self.project, self.services = spark, folder.rstrip("/"), project, services
        self.executor = executor or Executor(spark, f"{self.folder}/calls")
        self.decisions, self.risks, self.window = decisions, risks, window
        self.store = CommitLog(spark, f"{self.folder}/store")
        self.chunk_characters, self.points, self.target_language, self.citations = chunk_characters, points, target_language, citations

    def _active(self, part: str) -> dict | None:
        """The active release of a part, by the store; the project's own pointer follows it."""
        release = self.store.snapshot().pointers.get(f"release:{part}")
        if release is not None and self.project.active("release", part) != release:
            self.project.point("release", part, release)  # a run ended between the two
        return release

    def _approvals(self, release: dict | None) -> DataFrame | None:
        return None if release is None else self.store.snapshot().read("approvals").where(F.col("release_id") == release["release_id"]).drop("release_id")

    def _commit(self, part: str, units: DataFrame, outcomes: DataFrame, release: dict) -> None:
        """Records, units, approvals, event and pointer of a release, all or none of them."""
        key = release["release_id"]
        records_ = self.store.write("records", units.withColumn("release_id", F.lit(key)))
        approvals = self.store.write("approvals", outcomes.withColumn("release_id", F.lit(key)))
        event = self.store.write("events", self.spark.createDataFrame([(part, key, "RELEASE_ACTIVATED", release["documents"], release["outcomes"])], "part string, release_id string, event string, documents long, outcomes long"))

        def step(tx: Transaction) -> None:
            known = tx.pointer(f"known:{key}")
            if known is None:  # a release that was active before keeps its rows
                tx.add(records_)
                tx.add(approvals)
                tx.point(f"known:{key}", release)
            tx.add(event)
            tx.point(f"release:{part}", release)

        self.store.transact(step)
        self.project.point("release", part, release)

    def run(self, documents: DataFrame, part: str = "main") -> Result:
        with shuffles_dropped(self.spark):
            return self._run(documents, part)

    def _run(self, documents: DataFrame, part: str) -> Result:
        units = units_table(documents)
        try:
            return self._published(units, part)
        finally:
            drop_cut(units)

    def _published(self, units: DataFrame, part: str) -> Result:
        before, rendered, capture = self._active(part), None, False
        try:
            stored = self._approvals(before)
            if stored is None:
                raise MissingApprovals("no release yet")
            rendered = self.points.render(units, stored)
        except MissingApprovals:
            capture = True
        if self.decisions is not None:  # planned: directives, context, risks and routes by them
            todo, routes = planning.prepare(units, self.decisions, self.risks, *self.window)
        else:
            todo = units.where("disposition = 'translatable'").select("unit", "doc_id", "pos", "source_text")
            routes = self.points.plan(units.where("disposition = 'translatable'"))
        outcomes = Kernel(self.spark, self.executor, self.services, self.chunk_characters, self.target_language, self.citations).run(routes, todo)
        release = bus.release(outcomes, "doc_id", "pos")
        if release != before:
            self._commit(part, units, outcomes, release)
        approved = self._approvals(release)
        text = rendered if rendered is not None and release == before else self.points.render(units, approved)
        # What was rendered must be what the release holds, and the release must still be the active one.
        expected = outcomes.select("unit", F.lit(1).alias("revision"))
        if constraints.exact_cover(expected, approved.select("unit", F.lit(1).alias("revision")), "unit", "revision").limit(1).count() or bus.release(approved, "doc_id", "pos") != release:
            raise Blocked("approvals differ from the release")
        drop_cut(outcomes)  # the store holds them
        if self._active(part) != release:
            raise Blocked("the active release changed during rendering")
        target = f"{self.folder}/text/{release['release_id']}"
        text.write.mode("overwrite").option("compression", "zstd").parquet(target)
        text = self.spark.read.parquet(target)
        return Result(release, self._publish(part, release, units, approved, text), text, capture)

    def _publish(self, part: str, release: dict, units: DataFrame, approved: DataFrame, text: DataFrame) -> dict:
        found = self.points.verify(units, approved, text).groupBy("category", "severity").agg(F.count("*").alias("n")).collect()
        digest = bus.release(text.select("doc_id", F.lit(0).alias("pos"), F.sha2("text", 256).alias("outcome_id")), "doc_id", "pos")
        place = f"{self.folder}/text/{release['release_id']}"
        delivery = json.dumps({"text": place, "digest": digest["release_id"], "documents": digest["documents"]}, sort_keys=True).encode()
        report = {
            "release_id": release["release_id"], "target_sha256": hashlib.sha256(delivery).hexdigest(), "documents": digest["documents"],
            "findings": sorted([r.category, r.severity, r.n] for r in found),
            "verdict": "BLOCK" if any(r.severity in ("ERROR", "BLOCKING") for r in found) else "PASS",
        }
        report["report_id"] = hashlib.sha256(json.dumps(report, sort_keys=True).encode()).hexdigest()
        state = {"state": "RELEASED" if report["verdict"] == "PASS" else "BLOCKED", "report": report, "text": place}
        if not self.project.release(part, delivery, report, state):
            raise Blocked(f"the finished text did not pass: {report['findings'][:3]}")
        return report
