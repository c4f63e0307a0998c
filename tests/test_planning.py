"""Terms, context, risks and routes inside a run."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.executor import Executor
from ledgerloom.plans import planning, publication
from ledgerloom.plans.kernel import Blocked
from ledgerloom.plans.project import Project
from tests.test_control import services

DECIDED = [("heat flux", "热通量", "VERIFIED", "TRANSLATE_ONLY"), ("heat", "热", "SUPPORTED", "TRANSLATE_WITH_SOURCE_FIRST"), ("kernel", "核", "PROVISIONAL", "TRANSLATE_WITH_SOURCE_ALWAYS"), ("qubit", "qubit", "RETAINED_UNRESOLVED", "RETAIN_SOURCE")]
TEXT = "Plain line.\nThe heat flux is heat.\nheat again\n\nA kernel and a qubit"


def planned(spark, **more):
    units = publication.units_of(spark.createDataFrame([(1, TEXT, "en")], "doc_id long, text string, lang string"))
    decisions = spark.createDataFrame(DECIDED, "term string, form string, confidence string, treatment string")
    return units, decisions, *planning.prepare(units, decisions, **more)


def test_directives_context_and_routes(spark):
    units, decisions, todo, routes = planned(spark, before=1, after=1)
    got = {r.pos: r for r in todo.collect()}
    assert sorted(got) == [0, 1, 2, 4]
    demanded = {p: [(d.source_term, d.required) for d in r.directives] for p, r in got.items()}
    # The longer term first and alone; first uses in the order of the document; the source stands beside those that need it.
    assert demanded == {0: [], 1: [("heat flux", "热通量"), ("heat", "热（heat）")], 2: [("heat", "热")], 4: [("kernel", "核（kernel）"), ("qubit", "qubit")]}
    assert (got[2].context.before, got[2].context.after) == (["The heat flux is heat."], [""]) and got[0].context.before == []
    assert len({d.occurrence_key for r in got.values() for d in r.directives}) == 5
    ways = {r.unit: (r.level, r.lanes, r.reasons) for r in routes.collect()}
    assert ways["1:0"] == ("R1", ["baseline"], [])
    assert ways["1:1"] == ("R2", ["baseline", "alternative"], ["evidence-governed terminology"])
    assert ways["1:4"][0] == "R3" and "unresolved or provisional terminology" in ways["1:4"][2]
    told = spark.createDataFrame([("1:0", "R3", ["irony"], 1), ("1:0", "R9", ["x"], 2), ("9:9", "R3", ["x"], 1)], planning.RISKS)
    assert {r.unit: (r.level, r.reasons) for r in planning.prepare(units, decisions, told)[1].collect()}["1:0"] == ("R3", ["irony"])
    assert planning.prepare(units, decisions.limit(0))[1].where("level = 'R1'").count() == 4


def test_a_planned_run_demands_its_renderings(spark, tmp_path):
    src = tmp_path / "a.txt"
    src.write_text(TEXT)
    seen = []

    def follows(r):
        seen.append(set(r.columns))
        put = F.array_join(F.transform("directives", lambda d: d["required"]), "，")
        return r.select("call", F.concat(F.lit("译文："), put, F.lit(" "), "lane").alias("target_text"))

    def made(name, **own):
        p = Project(tmp_path / name)
        p.init(src)
        decisions = spark.createDataFrame(DECIDED, "term string, form string, confidence string, treatment string")
        folder = f"file://{tmp_path}/t-{name}"
        return publication.Publication(spark, folder, p, services(**own), Executor(spark, folder), target_language="zh-Hans", citations=True, decisions=decisions), p

    docs = publication.read_source(spark, str(src))
    run, p = made("good", generate=follows)
    text = run.run(docs).text.first().text
    assert {"directives", "context", "risks", "lane"} <= seen[0] and p.status() == "RELEASED"
    assert "热通量，热（heat）" in text and "核（kernel），qubit" in text
    ignored, q = made("bad", generate=lambda r: r.select("call", F.lit("没有术语的译文").alias("target_text")))
    with pytest.raises(Blocked, match="candidate.*rendering"):
        ignored.run(docs)
    assert q.active("release", "main") is None
