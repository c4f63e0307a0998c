"""What a run of the bus must refuse, what a publication must do as one step, and gates on large documents."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import constraints, gates
from ledgerloom.operators.executor import Executor
from ledgerloom.plans import project as projects
from ledgerloom.plans.kernel import Blocked, Kernel
from ledgerloom.plans.project import Project
from tests.test_control import services, two_units

FOUND = "array<struct<finding_id:string,option_key:string,severity:string,message:string,source_span:struct<s:int,e:int,quoted:string>,target_span:struct<s:int,e:int,quoted:string>>>"


def run(spark, folder, units=None, routes=None, own=None, **options):
    r, u = two_units(spark)
    k = Kernel(spark, Executor(spark, f"file://{folder}"), services(**(own or {})), **options)
    return {x.unit: x.edited_text for x in k.run(r if routes is None else routes, u if units is None else units).collect()}


def edits(text, impact="IMPROVES"):
    return {"edit": lambda r: r.select("call", text(r).alias("edited_text"), F.lit(impact).alias("impact"))}


def test_broken_texts_are_refused(spark, tmp_path):
    cases = {
        "control character": edits(lambda r: F.concat("target_text", F.lit("\x07"))),
        "unchanged": edits(lambda r: F.col("target_text")),  # nothing changed, and called an improvement
    }
    for i, (problem, own) in enumerate(cases.items()):
        with pytest.raises(Blocked, match=problem):
            run(spark, tmp_path / str(i), own=own)
    with pytest.raises(Blocked, match="candidate.*blank"):
        run(spark, tmp_path / "candidate", own={"generate": lambda r: r.select("call", F.lit("\n").alias("target_text"))})


def test_plans_are_refused(spark, tmp_path):
    routes = lambda *rows: spark.createDataFrame(list(rows), "unit string, lanes array<string>")
    for i, (problem, r) in enumerate({
        "plan: c.*extra": routes(("a", ["x"]), ("b", ["x"]), ("c", ["x"])), "plan: b.*missing": routes(("a", ["x"])), "plan: a.*duplicate": routes(("a", ["x"]), ("a", ["y"]), ("b", ["x"])),
        "lanes repeat": routes(("a", ["x", "x"]), ("b", ["x"])), "lane count": routes(("a", []), ("b", ["x"])),
    }.items()):
        with pytest.raises(Blocked, match=problem):
            run(spark, tmp_path / str(i), routes=r)
    levels = spark.createDataFrame([("a", ["x"], "R3", ["m"]), ("b", ["x"], "R1", [])], "unit string, lanes array<string>, level string, reasons array<string>")
    with pytest.raises(Blocked, match="R3 lanes"):
        run(spark, tmp_path / "r3", routes=levels)
    blocked = two_units(spark)[1].withColumn("disposition", F.when(F.col("unit") == "a", "blocker").otherwise("translatable"))
    with pytest.raises(Blocked, match="blocker: a"):
        run(spark, tmp_path / "blocker", units=blocked)


def test_untranslated_text_is_refused(spark, tmp_path):
    units = two_units(spark)[1].withColumn("source_text", F.lit("The heat flows down."))
    with pytest.raises(Blocked, match="verification"):
        run(spark, tmp_path / "zh", units=units, target_language="zh-Hans")
    chinese = {"generate": lambda r: r.select("call", F.lit("热量向下流动，不会停止。").alias("target_text"))}
    assert len(run(spark, tmp_path / "ok", units=units, own=chinese, target_language="zh-Hans")) == 2


def test_placeholders_and_directives_are_kept(spark, tmp_path):
    ns, token = "PT2-0123456789ab", "[[PT2-0123456789ab:F:0001]]"
    units = two_units(spark)[1].withColumn("source_text", F.concat(F.lit("heat "), F.lit(token))).withColumn("namespace", F.lit(ns))
    units = units.withColumn("specs", F.array(F.struct(F.lit("formula").alias("kind"), F.lit(token).alias("open_token"), F.lit(None).cast("string").alias("close_token"))))
    with pytest.raises(Blocked, match="edit.*count"):
        run(spark, tmp_path / "lost", units=units, own=edits(lambda r: F.replace("target_text", F.lit(token), F.lit(" "))))
    demands = F.array(F.struct(F.lit("k").alias("occurrence_key"), F.lit("heat").alias("source_term"), F.lit("Wärme").alias("required"), F.lit("TRANSLATE_ONLY").alias("treatment")))
    ruled = units.withColumn("directives", demands)
    with pytest.raises(Blocked, match="candidate.*rendering"):
        run(spark, tmp_path / "ignored", units=ruled)
    follows = {"generate": lambda r: r.select("call", F.replace("source_text", F.lit("heat"), r["directives"][0]["required"]).alias("target_text"))}
    assert set(run(spark, tmp_path / "followed", units=ruled, own=follows).values()) == {f"Wärme {token}"}


def reviews(**fields):
    """A service that finds something about every first option."""
    values = {"finding_id": F.lit("f"), "option_key": F.col("options")[0]["option_key"], "severity": F.lit("MINOR"), "message": F.lit("m"), "source_span": F.lit(None), "target_span": F.lit(None)} | fields

    def review(r):
        one = F.struct(*(v.alias(k) for k, v in values.items()))
        return r.select("call", F.array(one, *([one] if "twice" in fields else [])).cast(FOUND.replace("message:string,", "message:string,")).alias("findings"))

    return {"review": review}


def span(s, e, quoted):
    return F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(quoted).alias("quoted"))


def test_reviews_quote_what_stands_there(spark, tmp_path):
    units = two_units(spark)[1].withColumn("source_text", F.lit("one and one"))
    cases = {
        "unknown option": reviews(option_key=F.lit("0" * 64)), "citation": reviews(source_span=span(1, 4, "one")),  # the words are in the text, elsewhere
        "uncited": reviews(severity=F.lit("MAJOR")),
    }
    for i, (problem, own) in enumerate(cases.items()):
        with pytest.raises(Blocked, match=f"review.*{problem}"):
            run(spark, tmp_path / str(i), units=units, own=own, citations=True)
    assert len(run(spark, tmp_path / "right", units=units, own=reviews(source_span=span(8, 11, "one"), target_span=span(2, 5, "one")), citations=True)) == 2
    two = spark.createDataFrame([("k", "text")], "option_key string, target_text string").select(F.array(F.struct("option_key", "target_text")).alias("o"))
    f = F.struct(F.lit("f").alias("finding_id"), F.lit("k").alias("option_key"), F.lit("MINOR").alias("severity"), F.lit("m").alias("message"), F.lit(None).alias("source_span"), span(0, 2, "te").alias("target_span"))
    got = two.select(constraints.review_problems(F.col("o"), F.array(f, f).cast(FOUND), F.lit("s"), True).alias("p")).first().p
    assert got == ["repeated finding"]


def test_a_synthesis_reads_the_reports(spark, tmp_path):
    units = spark.createDataFrame([(f"u{i}", 1, i, f"text {i}") for i in range(70)], "unit string, doc_id long, pos int, source_text string")
    routes = units.select("unit", F.array(F.lit("baseline")).alias("lanes"))
    noted = lambda r: r.select("call", F.lit("PASS").alias("verdict"), F.array(F.array_join("texts", "")).alias("notes"))

    def joins(r):
        bad = F.exists("reports", lambda x: F.exists(x["notes"], lambda n: F.contains(n, F.lit("text 69|"))))
        return r.select("call", F.when(bad, "BLOCK").otherwise("PASS").alias("verdict"), F.flatten(F.transform("reports", lambda x: x["notes"])).alias("notes"))

    e = Executor(spark, f"file://{tmp_path}/a")
    with pytest.raises(Blocked, match="synthesis: 1"):
        Kernel(spark, e, services(review_document=noted, synthesize=joins), chunk_characters=5).run(routes, units)
    sizes = []

    def counts(r):
        sizes.extend(x.n for x in r.select(F.size("reports").alias("n")).collect())
        return r.select("call", F.lit("PASS").alias("verdict"), F.array(F.lit("x")).alias("notes"))

    e = Executor(spark, f"file://{tmp_path}/b")
    Kernel(spark, e, services(review_document=noted, synthesize=counts), chunk_characters=6).run(routes, units)
    assert sorted(sizes) == [2, 6, 64] and e.calls["synthesize"] == 3  # level by level


def test_a_publication_is_one_step(tmp_path, monkeypatch):
    src = tmp_path / "a.txt"
    src.write_text("x")
    p = Project(tmp_path / "p")
    p.init(src)
    report = lambda i, data: {"report_id": f"r{i}", "verdict": "PASS", "target_sha256": __import__("hashlib").sha256(data).hexdigest()}
    assert p.release("main", b"first", report(1, b"first"), {"state": "RELEASED"}) and p.status() == "RELEASED"
    steps = ["journal", "final", "reports", "active", "output"]
    whole = projects.write_atomic
    for i, broken in enumerate(steps, 2):
        data, before = f"text {i}".encode(), (p.folder / "final" / "main").read_bytes()

        def write(path, content, broken=broken):
            if path.parent.name == broken:
                raise OSError("killed")
            whole(path, content)

        monkeypatch.setattr(projects, "write_atomic", write)
        with pytest.raises(OSError, match="killed"):
            p.release("main", data, report(i, data), {"state": "RELEASED", "n": i})
        monkeypatch.setattr(projects, "write_atomic", whole)
        again = Project(p.folder)  # whoever comes next finishes it, or finds the former release
        assert again.status() == "RELEASED"
        assert (p.folder / "final" / "main").read_bytes() == (before if broken == "journal" else data)
        if broken != "journal":
            assert again.active("artifact", "main")["report_id"] == f"r{i}" and json.loads((p.folder / "output" / "verification-report.json").read_text())["n"] == i
    assert not list((p.folder / "journal").iterdir())
    with pytest.raises(projects.ControlError, match="different report"):
        p.release("main", b"z", report(1, b"z"), {})
    assert p.status() == "RELEASED"


def lines(spark, n):
    return spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("unit"), F.concat(F.lit("Line "), F.sha2(F.col("id").cast("string"), 256), F.lit(" ends")).alias("text"))


def test_containment_grows_with_the_document(spark):
    took = {}
    for n in (4_000, 16_000):
        units = lines(spark, n)
        page = units.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda r: r["text"]), "\n").alias("page_text")).select(F.lit(1).alias("page"), "page_text")
        page = page.withColumn("page_text", F.replace("page_text", F.sha2(F.lit("77"), 256), F.lit("gone")))
        rows = [(r.page, r.page_text) for r in page.collect()]
        page = spark.createDataFrame(rows, "page int, page_text string")
        begun = time.perf_counter()
        got = gates.missing_literals(units, page).collect()
        took[n] = time.perf_counter() - begun
        assert [(r.unit, r.n_missing) for r in got] == [(77, 1)]
    assert took[16_000] < 5 * max(took[4_000], 1.0), took


def test_absent_keys_of_odd_pages(spark):
    wanted = spark.createDataFrame([(1, "ab", 0), (1, "zz", 1), (1, "", 2), (2, "ab", 3), (3, "ab", 4), (3, "", 5), (None, "ab", 6), (4, "ab", 7)], "page int, key string, i int")
    pages = spark.createDataFrame([(1, "xxabyy"), (3, None), (4, ""), (5, "ab"), (None, "ab")], "page int, text_key string")
    for together in (20_000, 1):
        assert sorted(r.i for r in gates.absent(wanted, pages, together).collect()) == [1, 3, 4, 5, 6, 7]
    assert gates.absent(wanted.limit(0), pages).count() == 0
