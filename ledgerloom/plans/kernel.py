"""The review bus over all units of a part: candidates, review, adjudication, edit, verification, then the
review of whole documents and the release.

Every service call goes through an :class:`Executor`: what has a stored result is not called again,
so a run that was broken off continues at the first missing call and a completed one calls nothing.
Units run in parallel, a stage at a time.  Nothing is released unless every unit and every document
passed; the release itself is one small file that is moved into place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as ids
from ..functions.text import untranslated
from ..operators import bus, constraints, context
from ..operators.executor import Executor
from ..streaming.folders import drop_path, shuffles_dropped
from .project import Project

Stage = Callable[[DataFrame], DataFrame]

SPAN = "struct<s:int,e:int,quoted:string>"
CANDIDATE = "target_text string"
FINDINGS = f"findings array<struct<finding_id:string,option_key:string,severity:string,message:string,source_span:{SPAN},target_span:{SPAN}>>"
ADJUDICATION = "mode string, selected string, text string, resolutions array<struct<finding_id:string,action:string>>"
EDIT = "edited_text string, impact string"
VERDICT = "verdict string, notes array<string>"

#: What units may bring along besides their text: all services but the document's read it.
CARRIED = ("context", "directives", "risks", "namespace", "specs")


class Blocked(RuntimeError):
    """Some unit, adjudication or document did not pass."""


@dataclass
class Services:
    """The calls of a run, each from a table of requests to a table of replies with the same ``call``.

    ``generate`` reads unit, lane, source_text; ``review`` unit, source_text and blind options;
    ``adjudicate`` unit, options and findings; ``edit`` unit, source_text and target_text; ``verify``
    unit, source_text and edited_text; all of them what the unit carries (context, directives, risks,
    placeholder contract); ``review_document`` the texts of a chunk of a document; ``synthesize`` the
    reports of up to 64 chunks, or of as many syntheses of these.  ``adjudicate`` defaults to the rules
    of :func:`bus.by_rules`.
    """

    generate: Stage
    review: Stage
    edit: Stage
    verify: Stage
    review_document: Stage
    synthesize: Stage
    adjudicate: Stage = field(default=lambda requests: bus.by_rules(requests))


class Kernel:
    """``target_language`` turns on the gate for text that was left untranslated, ``citations`` asks serious findings for quotations."""

    def __init__(self, spark: SparkSession, executor: Executor, services: Services, chunk_characters: int = 40_000, target_language: str | None = None, citations: bool = False):
        self.spark, self.executor, self.services, self.chunk_characters = spark, executor, services, chunk_characters
        self.target_language, self.citations = target_language, citations
        self._asked: list[str] = []

    def _stage(self, stage: str, requests: DataFrame, service: Stage, schema: str, beside: tuple[str, ...] = ()) -> DataFrame:
        """Requests with the replies of their calls; a call is known by its stage and all that it reads.

        Columns ``beside`` come along unread.  ``_problem`` holds what is wrong with what the stage before gave: nothing
        is called if there is any.
        """
        beside = tuple(c for c in (*beside, "_problem", "_what") if c in requests.columns)
        reads = F.to_json(F.struct(*sorted(c for c in requests.columns if c not in beside)), {"ignoreNullFields": "false"})
        # Written once, so that no later stage plans or runs this one's joins again.
        path = f"{self.executor.folder}/requests/{stage}-{uuid.uuid4().hex}"
        self._asked.append(path)
        requests.withColumn("call", ids.call_key(F.lit(stage), reads)).write.option("compression", "zstd").parquet(path)
        self._drop(keep=1)  # those of the stage before, from which these were made
        asked = self.spark.read.parquet(path)
        if "_problem" in beside:
            self._none(asked.where("_problem IS NOT NULL"), None)
            asked = asked.drop("_problem", "_what")
        self.executor.execute(stage, asked.drop(*beside), service, schema)
        return asked.join(self.executor.results(stage, schema).hint("merge"), "call").drop("call")

    def _drop(self, keep: int = 0) -> None:
        """Deletes the requests of earlier stages, which nothing reads any more."""
        while len(self._asked) > keep:
            drop_path(self.spark, self._asked.pop(0))

    def run(self, routes: DataFrame, units: DataFrame, project: Project | None = None, part: str = "main") -> DataFrame:
        """Outcomes ``unit, doc_id, pos, edited_text, impact, outcome_id`` of all units; raises :class:`Blocked` unless all pass.

        ``routes``: unit, lanes and, if known, level and reasons; ``units``: unit, doc_id, pos,
        source_text and any of ``CARRIED``: context, risks, directives (array of occurrence_key,
        source_term, required, treatment), namespace and specs of a placeholder contract.
        """
        try:
            with shuffles_dropped(self.spark):
                outcomes = self._units(routes, units)
                self._drop()
                self._documents(outcomes)
                if project is not None:
                    project.point("release", part, bus.release(outcomes, "doc_id", "pos"))
                return outcomes
        finally:
            self._drop()

    def _plan(self, routes: DataFrame, units: DataFrame) -> DataFrame:
        """Units with their lanes, written once: every unit has one route, every route a unit, and its lanes fit its level."""
        level = F.col("level") if "level" in routes.columns else F.when(F.size("lanes") > 1, "R2").otherwise("R1")
        reasons = F.col("reasons") if "reasons" in routes.columns else F.array(F.lit("not stated"))
        wrong = constraints.route_problems(level, F.col("lanes"), reasons)
        own = routes.select("unit", "lanes", wrong.alias("_route")).groupBy("unit").agg(F.count("*").alias("_n"), F.first("lanes").alias("lanes"), F.max("_route").alias("_route"))
        given = units.select("unit", "doc_id", "pos", "source_text", *(c for c in (*CARRIED, "disposition") if c in units.columns), F.lit(1).alias("_there"))
        cover = F.when(F.col("_n").isNull(), "missing").when(F.col("_there").isNull(), "extra").when(F.col("_n") > 1, "duplicate")
        blocker = (F.col("disposition") == "blocker") if "disposition" in units.columns else F.lit(False)
        problem = F.when(cover.isNotNull(), F.array(cover)).when(F.size("_route") > 0, F.col("_route")).when(blocker, F.array().cast("array<string>"))
        what = F.when(cover.isNotNull(), "plan").when(F.size("_route") > 0, "route").otherwise("blocker")
        path = f"{self.executor.folder}/requests/plan-{uuid.uuid4().hex}"
        self._asked.append(path)
        both = given.join(own, "unit", "full_outer").withColumns({"_problem": problem, "_what": what})
        both.drop("_n", "_route", "_there", "disposition").write.option("compression", "zstd").parquet(path)
        plan = self.spark.read.parquet(path)
        self._none(plan.where("_problem IS NOT NULL").orderBy(F.array_position(F.array(*map(F.lit, ("plan", "route", "blocker"))), F.col("_what"))), None)
        return plan.drop("_problem", "_what")

    def _texts(self, rows: DataFrame, text: str, stage: str, *others: Column) -> DataFrame:
        """Texts that a service gave must be printable, keep protected tokens and hold what directives demand; ``others``: more problems.

        Adds ``_problem`` and ``_what``, which the next stage looks at before it calls.
        """
        found = F.concat(*others, constraints.target_problems(F.col(text)))
        if "specs" in rows.columns:
            damage = constraints.placeholder_problems(F.col(text), F.col("namespace"), F.col("specs"))
            found = F.concat(found, F.when(F.size("specs") > 0, damage).otherwise(F.array().cast("array<string>")))
        if "directives" in rows.columns:
            found = F.concat(found, F.coalesce(constraints.directive_problems(F.col(text), F.col("directives")), F.array().cast("array<string>")))
        return self._marked(rows, found, stage, F.col(text).isNull())

    @staticmethod
    def _marked(rows: DataFrame, problem: Column, stage: str, also: Column | None = None) -> DataFrame:
        """Adds ``_problem``, null where nothing is wrong, and ``_what``, the stage."""
        bad = F.size("_found") > 0
        return rows.withColumn("_found", problem).withColumns({"_problem": F.when(bad if also is None else also | bad, F.col("_found")), "_what": F.lit(stage)}).drop("_found")

    def _untranslated(self, rows: DataFrame) -> Column:
        if self.target_language is None:
            return F.lit(False)
        none = F.array().cast("array<string>")
        own = lambda keep, name: F.coalesce(F.transform(F.filter("directives", keep), lambda d: d[name]), none) if "directives" in rows.columns else none
        every, kept = (lambda d: F.lit(True)), (lambda d: d["treatment"] == "RETAIN_SOURCE")
        return untranslated(F.col("source_text"), F.col("edited_text"), F.lit(self.target_language), own(every, "source_term"), own(every, "required"), own(kept, "source_term"))

    def _units(self, routes: DataFrame, units: DataFrame) -> DataFrame:
        s, carried = self.services, [c for c in CARRIED if c in units.columns]
        place = ("doc_id", "pos")  # no service reads it
        asked = self._plan(routes, units).select("unit", "source_text", *carried, *place, F.explode("lanes").alias("lane"))
        made = self._stage("generate", asked, s.generate, CANDIDATE, place)
        named = made.withColumn("candidate_id", F.sha2(F.concat_ws("\n", F.col("unit").cast("string"), "lane", "target_text"), 256))
        options = self._texts(bus.options(named, "source_text", *carried, *place), "target_text", "candidate")
        own = F.first(F.struct("source_text", *carried, *place)).alias("_own")
        per_unit = bus.option_sets(options, F.max("_problem").alias("_problem"), own).select("unit", "options", "_own.*", "_problem", F.lit("candidate").alias("_what"))
        reviewed = self._stage("review", per_unit, s.review, FINDINGS, place)
        shape = constraints.review_problems(F.col("options"), F.col("findings"), F.col("source_text"), self.citations)
        judged = self._stage("adjudicate", self._marked(reviewed, shape, "review"), s.adjudicate, ADJUDICATION, place)
        wrong = constraints.adjudication_problems(F.col("mode"), F.col("selected"), F.col("findings"), F.col("resolutions"))
        text = F.when(F.col("mode") == "SELECT", F.filter("options", lambda o: o["option_key"] == F.col("selected"))[0]["target_text"]).otherwise(F.col("text"))
        judged = judged.withColumns({"_wrong": wrong, "target_text": text})
        ruled = self._texts(judged, "target_text", "adjudication", F.col("_wrong")).select("unit", "source_text", "target_text", *carried, *place, "_problem", "_what")
        edited = self._texts(self._stage("edit", ruled, s.edit, EDIT, place), "edited_text", "edit")
        edited = edited.withColumn("changed", ~F.col("target_text").eqNullSafe(F.col("edited_text")))
        checked = self._stage("verify", edited, s.verify, FINDINGS, place).withColumn("_serious", bus.is_serious(F.col("findings")))
        checked = checked.withColumn("_serious", F.col("_serious") | self._untranslated(checked))
        verdict = F.when(F.col("_serious") | (F.col("impact") == "DEGRADES"), "BLOCK").otherwise("PASS")
        checked = checked.withColumn("verdict", verdict)
        verified = self._marked(checked, constraints.verdict_problems(F.col("verdict"), F.col("_serious"), F.col("impact"), F.col("changed")), "verification", F.col("verdict") == "BLOCK")
        key = ids.digest(ids.NS_OPTION, candidate=F.sha2("edited_text", 256), unit=F.col("unit").cast("string"))
        outcomes = verified.select("unit", "edited_text", "impact", key.alias("outcome_id"), *place, "_problem", "_what")
        # Read again from one place: the requests go when the run is over.
        path = f"{self.executor.folder}/outcomes/{uuid.uuid4().hex}"
        outcomes.write.option("compression", "zstd").parquet(path)
        written = self.spark.read.schema(outcomes.schema).parquet(path)
        try:
            self._none(written.where("_problem IS NOT NULL"), None)
        except Blocked:
            drop_path(self.spark, path)
            raise
        return written.drop("_problem", "_what")

    def _documents(self, outcomes: DataFrame) -> None:
        """Review of whole documents, in chunks of bounded size; several passing chunks need a synthesis."""
        sized = outcomes.select("doc_id", "pos", "edited_text", F.length("edited_text").alias("n"))
        parts = context.chunks(sized, "doc_id", "pos", "n", self.chunk_characters, carry=["edited_text"])
        rows = F.array_sort(F.collect_list(F.struct("pos", "edited_text")))
        chunks = parts.groupBy("doc_id", "chunk").agg(F.transform(rows, lambda r: r["edited_text"]).alias("texts"))
        reports = self._stage("review_document", chunks, self.services.review_document, VERDICT)
        self._none(bus.merge_reports(reports).where("verdict = 'BLOCK'"), "document review")
        level = reports.select("doc_id", F.col("chunk").cast("int").alias("part"), "verdict", "notes")
        while True:
            groups = bus.report_groups(level)
            if not groups.limit(1).count():
                self.executor.calls.setdefault("synthesize", 0)
                break
            level = self._stage("synthesize", groups, self.services.synthesize, VERDICT).select("doc_id", "part", "verdict", "notes")
            self._none(level.where("verdict = 'BLOCK'"), "synthesis")

    @staticmethod
    def _none(bad: DataFrame, what: str | None) -> None:
        if rows := bad.limit(1).collect():
            r = rows[0].asDict()
            raise Blocked(f"{what or r['_what']}: {r.get('unit', r.get('doc_id'))} did not pass{': ' + str(r['_problem']) if r.get('_problem') else ''}")
