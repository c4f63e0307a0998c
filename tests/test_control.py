"""Projects, command line, kernel resume, blobs, evidence catalog."""

import io
import json
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerloom import cli, server
from ledgerloom.functions import text, values
from ledgerloom.operators import gates, ledger, terms
from ledgerloom.operators.executor import BudgetExceeded, Busy, Executor, Exhausted, PermanentError
from ledgerloom.plans import publication
from ledgerloom.plans.kernel import Blocked, Kernel, Services
from ledgerloom.plans.project import Config, ControlError, Project
from ledgerloom.sources import blobs, evidence, records


def test_project_binds_inputs(tmp_path):
    src = tmp_path / "a.txt"
    src.write_text("hello")
    p = Project(tmp_path / "p")
    assert p.status() == "NEW"
    assert p.init(src) == p.init(src)
    assert p.status(units=3) == "IN_PROGRESS" and dict(p.doctor())["control"] == "PASS"
    src.write_text("other")
    with pytest.raises(ControlError):
        p.init(src)
    (p.folder / "inputs" / "a.txt").write_text("tampered")
    assert p.status() == "BLOCKED" and dict(p.doctor())["control"] == "BLOCK"


def test_release_states(tmp_path):
    src = tmp_path / "a.txt"
    src.write_text("x")
    p = Project(tmp_path / "p")
    p.init(src)
    p.point("release", "main", {"id": "r"})
    assert p.status() == "VERIFYING"
    assert not p.record_report("main", {"report_id": "1", "verdict": "BLOCK", "target_sha256": "0"})
    assert p.status() == "BLOCKED"
    sha = p.publish("main", b"final")
    assert p.record_report("main", {"report_id": "2", "verdict": "PASS", "target_sha256": sha})
    assert p.status() == "RELEASED"
    assert p.collect(tmp_path / "out") == p.collect(tmp_path / "out") == [{"name": "main", "sha256": sha, "size": 5}]
    with pytest.raises(ControlError):
        p.record_report("main", {"report_id": "2", "verdict": "PASS", "target_sha256": "1"})
    (p.folder / "final" / "main").write_bytes(b"changed")
    assert p.status() == "BLOCKED"


@pytest.mark.parametrize("bad", [{"nope": 1}, {"max_calls": "5"}, {"max_calls": 0}, {"endpoint": "http://x"}, {"max_calls": True}, {"role_models": {"pilot": "m"}}, {"role_models": {"editor": " "}}, {"reasoning_effort": "huge"}, {"provider": " "}, {"enable_web_research": 1}])
def test_config_is_strict(tmp_path, bad):
    f = tmp_path / "c.json"
    f.write_text(json.dumps(bad))
    with pytest.raises(ControlError):
        Config.load(f)


def test_cli(tmp_path, capsys):
    src = tmp_path / "a.txt"
    src.write_text("x")
    assert cli.main(["init", str(tmp_path / "p"), str(src)]) == 0
    assert cli.main(["status", str(tmp_path / "p")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"state": "NEW"}
    assert cli.main(["collect", str(tmp_path / "p"), str(tmp_path / "o")]) == 2


def services(**other):
    """Services that answer with the source text; named as a factory for the command line too."""
    found = lambda: F.array().cast("array<struct<finding_id:string,option_key:string,severity:string,message:string>>")
    passed = lambda r: r.select("call", F.lit("PASS").alias("verdict"), F.array().cast("array<string>").alias("notes"))
    own = {
        "generate": lambda r: r.select("call", F.concat(F.lit("T:"), "source_text", F.lit("|"), "lane").alias("target_text")),
        "review": lambda r: r.select("call", found().alias("findings")),
        "edit": lambda r: r.select("call", F.col("target_text").alias("edited_text"), F.lit("EQUIVALENT").alias("impact")),
        "verify": lambda r: r.select("call", found().alias("findings")),
        "review_document": passed, "synthesize": passed,
    }
    return Services(**{**own, **other})


def chinese():
    return services(generate=lambda r: r.select("call", F.concat(F.lit("这是第一行的译文"), "lane").alias("target_text")))


def two_units(spark):
    routes = spark.createDataFrame([("a", ["baseline"]), ("b", ["baseline", "alternative"])], "unit string, lanes array<string>")
    units = spark.createDataFrame([("a", 1, 0, "one"), ("b", 1, 1, "two")], "unit string, doc_id long, pos int, source_text string")
    return routes, units


def test_kernel_calls_twelve_times_and_never_again(spark, tmp_path):
    routes, units = two_units(spark)
    p, folder = Project(tmp_path / "p"), f"file://{tmp_path}/run"
    e = Executor(spark, folder)
    out = {r.unit: r.edited_text for r in Kernel(spark, e, services()).run(routes, units, p).collect()}
    assert e.calls == {"generate": 3, "review": 2, "adjudicate": 2, "edit": 2, "verify": 2, "review_document": 1, "synthesize": 0} and sum(e.calls.values()) == 12
    assert out["a"] == "T:one|baseline" and out["b"].startswith("T:two|")
    first = p.active("release", "main")
    again = Executor(spark, folder)
    Kernel(spark, again, services()).run(routes, units, p)
    assert sum(again.calls.values()) == 0 and p.active("release", "main") == first and first["outcomes"] == 2


def test_kernel_selects_by_findings_and_blocks(spark, tmp_path):
    routes, units = two_units(spark)
    serious = lambda o, s: F.struct(F.concat(F.lit("f"), o["option_key"]).alias("finding_id"), o["option_key"].alias("option_key"), F.lit(s).alias("severity"), F.lit("m").alias("message"))
    about = lambda end, s="MAJOR": (lambda r: r.select("call", F.transform(F.filter("options", lambda o: o["target_text"].endswith(end)), lambda o: serious(o, s)).alias("findings")))
    p = Project(tmp_path / "p")
    two, two_b = routes.where("unit = 'b'"), units.where("unit = 'b'")
    for lane, other in (("baseline", "alternative"), ("alternative", "baseline")):
        (row,) = Kernel(spark, Executor(spark, f"file://{tmp_path}/{lane}"), services(review=about(lane))).run(two, two_b, p).collect()
        assert row.edited_text == f"T:two|{other}"
    with pytest.raises(PermanentError):  # every option has a serious finding and no service synthesizes
        Kernel(spark, Executor(spark, f"file://{tmp_path}/both"), services(review=about("e"))).run(two, two_b, p, part="both")
    degrades = lambda r: r.select("call", F.lit("x").alias("edited_text"), F.lit("DEGRADES").alias("impact"))
    blocks = lambda r: r.select("call", F.lit("BLOCK").alias("verdict"), F.array().cast("array<string>").alias("notes"))
    for k, other in enumerate(({"edit": degrades}, {"review_document": blocks})):
        with pytest.raises(Blocked):
            Kernel(spark, Executor(spark, f"file://{tmp_path}/blocked{k}"), services(**other)).run(two, two_b, p, part="blocked")
    assert p.active("release", "both") is None and p.active("release", "blocked") is None
    with pytest.raises(Blocked):  # two chunks that pass need a synthesis, which blocks
        Kernel(spark, Executor(spark, f"file://{tmp_path}/synthesis"), services(synthesize=blocks), chunk_characters=5).run(routes, units)


class Clock:
    def __init__(self):
        self.now = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def __call__(self):
        return self.now


def requests(spark, n=2):
    return spark.createDataFrame([(f"c{i}", i) for i in range(n)], "call string, x int")


def test_executor_retries_refuses_and_remembers(spark, tmp_path):
    waits = []
    e = Executor(spark, f"file://{tmp_path}/a", sleep=waits.append)
    attempt = lambda: e.attempts().groupBy("call").agg(F.max("ordinal").alias("o"))
    flaky = lambda r: r.join(attempt(), "call").select("call", F.col("x").alias("y"), F.when((F.col("x") == 1) & (F.col("o") < 3), "rate_limit").alias("error"), F.lit(9.0).alias("retry_after"))
    assert sorted(r.y for r in e.execute("s", requests(spark), flaky, "y int").collect()) == [0, 1]
    assert e.calls == {"s": 4} and waits == [9.0, 9.0] and e.usage()[0] == 4
    assert [r.outcome for r in e.attempts().where("call = 'c1'").orderBy("ordinal").collect()] == ["RETRYABLE_FAILURE", "RETRYABLE_FAILURE", "SUCCEEDED"]
    again = Executor(spark, f"file://{tmp_path}/a")
    again.execute("s", requests(spark), flaky, "y int")
    assert again.calls == {"s": 0}
    always = lambda kind: (lambda r: r.select("call", F.col("x").alias("y"), F.lit(kind).alias("error")))
    waits = []
    with pytest.raises(Exhausted):
        Executor(spark, f"file://{tmp_path}/b", sleep=waits.append).execute("s", requests(spark, 1), always("timeout"), "y int")
    assert waits == [1.0, 2.0]
    for _ in range(2):  # a refusal is final, in later runs too
        with pytest.raises(PermanentError):
            Executor(spark, f"file://{tmp_path}/c").execute("s", requests(spark, 1), always("invalid"), "y int")
    assert Executor(spark, f"file://{tmp_path}/c").usage()[0] == 1
    with pytest.raises(PermanentError):
        Executor(spark, f"file://{tmp_path}/b").execute("s", requests(spark, 1), always(None), "y int")


def test_executor_budget(spark, tmp_path):
    good = lambda r: r.select("call", F.col("x").alias("y"))
    e = Executor(spark, f"file://{tmp_path}/a", max_calls=3)
    with pytest.raises(BudgetExceeded):
        e.execute("s", requests(spark, 5), good, "y int")
    assert e.calls == {"s": 3} and e.results("s", "y int").count() == 3
    with pytest.raises(BudgetExceeded):
        e.execute("s", requests(spark, 5), good, "y int")
    assert e.usage()[0] == 3
    more = Executor(spark, f"file://{tmp_path}/a", max_cost=50.0)
    assert more.execute("s", requests(spark, 5), good, "y int", cost=25.0).count() == 5 and more.usage() == (5, 50.0)
    assert more.execute("s", requests(spark, 5), good, "y int", cost=25.0).count() == 5  # cached results are free


def test_executor_leases(spark, tmp_path):
    clock = Clock()
    good = lambda r: r.select("call", F.col("x").alias("y"))

    def broken(r):
        raise RuntimeError("lost")

    folder = f"file://{tmp_path}/a"
    with pytest.raises(RuntimeError, match="lost"):
        Executor(spark, folder, owner="one", lease_seconds=10, clock=clock).execute("s", requests(spark), broken, "y int")
    two = Executor(spark, folder, owner="two", lease_seconds=10, clock=clock)
    clock.now += timedelta(seconds=5)
    with pytest.raises(Busy, match="one"):
        two.execute("s", requests(spark), good, "y int")
    clock.now += timedelta(seconds=6)
    assert two.execute("s", requests(spark), good, "y int").count() == 2 and two.taken_over == 2
    assert {(r.ordinal, r.outcome) for r in two.attempts().collect()} == {(1, "ABANDONED"), (2, "SUCCEEDED")}

    def slow(r):
        clock.now += timedelta(seconds=12)
        return good(r)

    late = Executor(spark, f"file://{tmp_path}/b", lease_seconds=10, clock=clock)
    with pytest.raises(Busy, match="ran out"):
        late.execute("s", requests(spark), slow, "y int")
    assert late.results("s", "y int").count() == 0  # nothing is committed under a lease that ran out


def test_publication_runs_verifies_and_resumes(spark, tmp_path):
    src = tmp_path / "a.txt"
    src.write_text("It must hold in 1999.\n\nPlain line.\n12.5")
    p = Project(tmp_path / "p")
    p.init(src)
    docs = publication.read_source(spark, str(src))
    made = publication.Publication(spark, f"file://{tmp_path}/t", p, services())
    first = made.run(docs)
    assert first.capture_needed and first.report["verdict"] == "PASS" and p.status() == "RELEASED"
    assert first.text.first().text in {f"T:It must hold in 1999.|{x}\n\nT:Plain line.|baseline\n12.5" for x in ("baseline", "alternative")}
    again = publication.Publication(spark, f"file://{tmp_path}/t", p, services())
    second = again.run(docs)
    assert not second.capture_needed and sum(again.executor.calls.values()) == 0 and second.report == first.report
    (files,) = p.collect(tmp_path / "out")
    assert files["sha256"] == first.report["target_sha256"]
    loses = lambda r: r.select("call", F.lit("anchors are gone").alias("edited_text"), F.lit("EQUIVALENT").alias("impact"))
    q = Project(tmp_path / "q")
    q.init(src)
    with pytest.raises(Blocked, match="ANCHOR"):
        publication.Publication(spark, f"file://{tmp_path}/u", q, services(edit=loses)).run(docs)
    assert q.status() == "BLOCKED" and json.loads((q.folder / "output" / "verification-report.json").read_text())["state"] == "BLOCKED"
    with pytest.raises(publication.MissingApprovals):
        publication.render(publication.units_of(docs), spark.createDataFrame([], "unit string, edited_text string"))


def test_leases_follow_grants(spark):
    rows = [("a", t, k) for k, t in enumerate((0, 50, 120, 219, 220))] + [("b", 7, 9)]
    df = spark.createDataFrame(rows, "call string, at long, k int").withColumn("ts", F.timestamp_seconds("at"))
    got = {(r.call, r.at): (r.granted, r.takeover) for r in ledger.leases(df, "call", ["ts", "k"], 100).collect()}
    assert got == {("a", 0): (True, False), ("a", 50): (False, False), ("a", 120): (True, True), ("a", 219): (False, False), ("a", 220): (True, True), ("b", 7): (True, False)}
    df = spark.createDataFrame([("a", 0, 0), ("a", 5, 1), ("a", 11, 2)], "call string, at long, k int").withColumn("ts", F.timestamp_seconds("at"))
    assert [r.granted for r in ledger.leases(df, "call", ["ts", "k"], 10).orderBy("at").collect()] == [True, False, True]


def test_write_once_reports_conflicts(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    incoming = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x"), (3, None), (4, "n"), (4, "n"), (5, "p"), (5, "q"), (6, None)], "k int, v string")
    assert {r.k: r.state for r in ledger.write_once(stored, incoming, "k", "v").collect()} == {1: "replay", 2: "conflict", 3: "replay", 4: "new", 5: "conflict", 6: "new"}
    with pytest.raises(ledger.Conflict, match="2, 5"):
        ledger.insert_once(stored, incoming, "k", "v")
    assert [tuple(r) for r in ledger.insert_once(stored, incoming.where("k in (1, 4)"), "k", "v").collect()] == [(4, "n")]


def test_budget_fold_lets_a_smaller_one_in(spark):
    df = spark.createDataFrame([("s", k, c) for k, c in enumerate((50.0, 60.0, 40.0, 10.0, 10.0))] + [("t", 0, 101.0)], "scope string, k int, c double")
    got = sorted((r.scope, r.k, r.admitted, r.spent) for r in ledger.admit_by_budget(df, "scope", ["k"], "c", 100.0).collect())
    assert got == [("s", 0, True, 50.0), ("s", 1, False, 50.0), ("s", 2, True, 90.0), ("s", 3, True, 100.0), ("s", 4, False, 100.0), ("t", 0, False, 0.0)]
    assert [r.admitted for r in ledger.admit_by_budget(df.where("scope = 's'"), "scope", ["k"], "c", 1000.0, max_calls=2).orderBy("k").collect()] == [True, True, False, False, False]


def test_secret_keys_of_malformed_text(spark):
    df = spark.createDataFrame([("{",), ('{"token": 1}',), (None,), ("[1]",)], "j string")
    assert [r.b for r in df.select(values.has_secret_key(F.col("j")).alias("b")).collect()] == [None, True, False, False]


def test_excerpt_keeps_places_where_case_changes_length(spark):
    df = spark.createDataFrame([("İİİİ abc HEAT def", "heat"), ("a.b A.B", "a.b"), ("x", "\\E"), ("q \\E z", "\\e"), ("none", "heat")], "t string, k string")
    assert [r.e for r in df.select(text.excerpt(F.col("t"), F.col("k"), 2).alias("e")).collect()] == ["c HEAT d", "a.b A", None, "q \\E z", None]


def test_missing_literals_are_in_text_order(spark):
    mark = "[[PT2-0123456789ab:F:0001]]"
    units = spark.createDataFrame([(1, 1, f"zeta{mark}alpha{mark}beta{mark}alpha{mark}here")], "unit int, page int, text string")
    pages = spark.createDataFrame([(1, "only he re")], "page int, page_text string")
    r = gates.missing_literals(units, pages).first()
    assert r.evidence == ["zeta", "alpha", "beta"] and r.n_missing == 4


def test_conventionality_is_ranked(spark):
    row = ("t", "f", "w1", "B_DOMAIN", "SUPPORTS", True, True)
    df = spark.createDataFrame([(*row, "ESTABLISHED"), ("t", "f", "w2", "C_CORPUS", "SUPPORTS", True, True, "UNATTESTED")], "term string, form string, authority string, tier string, stance string, sense_match boolean, domain_match boolean, conventionality string")
    r = terms.confidence(df).first()
    assert (r.conventionality, r.confidence) == ("ESTABLISHED", "VERIFIED")


def test_many_terms_and_odd_texts(spark):
    units = spark.createDataFrame([(1, "aaa abab", 5), (2, None, 5), (3, "", 5), (4, "\U0001f600ab", 5)], "k long, source_text string, s int")
    found = terms.occurrences(units, spark.createDataFrame([(f"none{i}",) for i in range(5000)] + [("ab",), ("a",), ("aa",), ("",)], "term string"))
    assert found.columns == ["k", "source_text", "term", "s", "e"]
    assert sorted((r.k, r.term, r.s, r.e) for r in found.collect()) == [(1, "a", 2, 3), (1, "aa", 0, 2), (1, "ab", 4, 6), (1, "ab", 6, 8), (4, "ab", 1, 3)]
    assert terms.occurrences(units, []).count() == 0
    with pytest.raises(ValueError):
        terms.occurrences(units, ["a", "b"], max_terms=1)


def test_manifest_parts(spark):
    docs = spark.createDataFrame([(1, "a\n12"), (2, "b")], "doc_id long, text string")
    manifest = records.register(records.segment(docs), "doc_id")
    assert [tuple(r) for r in records.load_document(manifest, "1").orderBy("para").collect()] == [(0, "a", "translatable", "TEXT"), (1, "12", "safe_exclusion", "PURE_NUMERIC")]
    with pytest.raises(KeyError):
        records.load_document(manifest, "3")
    with pytest.raises(KeyError):
        records.load_document(manifest.withColumn("blob", F.lit("{")), "1")
    own = records.identify(records.segment(docs))
    assert records.ingest(own).count() == 3
    with pytest.raises(records.Divergent, match="document 2, paragraph 0: revision"):
        records.ingest(own.withColumn("source_text", F.when(F.col("doc_id") == 2, "c").otherwise(F.col("source_text"))))


def test_pages_behind_redirects(spark):
    urls = [(f"http://h{i}.org/", f"http://h{i + 1}.org/") for i in range(6)]
    redirects = spark.createDataFrame(urls, "url string, location string")
    pages = spark.createDataFrame([("http://h6.org/", "<p>six</p>"), ("http://big.org/", "x" * 2_000_001), ("http://h9.org:8080/", "port"), ("http://in.org/", "inside")], "url string, html string")
    hosts = spark.createDataFrame([(f"h{i}.org", "8.8.8.8") for i in range(10)] + [("big.org", "8.8.8.8"), ("in.org", "8.8.8.8"), ("in.org", "10.0.0.1")], "host string, address string")
    asked = spark.createDataFrame([(f"http://h{i}.org/",) for i in range(7)] + [("http://big.org/",), ("http://h9.org:8080/",), ("http://in.org/",), ("ftp://h1.org/",), ("http://nowhere.org/",)], "url string")
    got = {r.url: (r.final_url, r.page_text) for r in evidence.resolve(asked, redirects, hosts, pages).collect()}
    assert {u for u, (_, t) in got.items() if t} == {f"http://h{i}.org/" for i in (3, 4, 5, 6)} and got["http://h3.org/"] == ("http://h6.org/", "six")
    assert got["http://in.org/"] == (None, None) and got["http://h9.org:8080/"] == (None, None) and len(got) == 12


def test_older_projects_are_migrated(tmp_path):
    src = tmp_path / "a.txt"
    src.write_text("x")
    p = Project(tmp_path / "p")
    new = p.init(src)
    old = {k: v for k, v in new.items() if k != "parts"} | {"schema_version": 1}
    (p.folder / "control.json").write_text(json.dumps(old))
    assert p.manifest() == new and json.loads((p.folder / "control.json").read_text()) == new
    for bad in ({"schema_version": 3}, {"schema_version": "1"}, {"schema_version": 0}, {"extra": 1}):
        (p.folder / "control.json").write_text(json.dumps(new | bad))
        with pytest.raises(ControlError):
            p.manifest()


def test_cli_runs_a_project(spark, tmp_path, capsys):
    src = tmp_path / "a.txt"
    src.write_text("One line.\nAnother one.")
    folder, factory = str(tmp_path / "p"), "tests.test_control:chinese"
    left = str(tmp_path / "left")  # the target language is Chinese: services that repeat the source are refused
    assert cli.main(["translate", left, str(src), str(tmp_path / "none"), "--services", "tests.test_control:services"]) == 2 and Project(left).active("release", "main") is None
    capsys.readouterr()
    assert cli.main(["translate", folder, str(src), str(tmp_path / "out"), "--services", factory]) == 0
    first = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert first["state"] == "RELEASED" and first["calls"] == 2 + 2 * 4 + 1 and (tmp_path / "out" / "main").exists()
    assert cli.main(["resume", folder, "--services", factory]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["calls"] == 0
    assert cli.main(["init", str(tmp_path / "q"), str(src)]) == 0 and cli.main(["resume", str(tmp_path / "q"), "--services", factory]) == 2


def test_server_lists_and_calls_tools(tmp_path):
    src = tmp_path / "a.txt"
    src.write_text("x")
    ask = lambda method, n=1, **params: server.handle({"jsonrpc": "2.0", "id": n, "method": method, "params": params})
    tool = lambda name, **arguments: ask("tools/call", name=name, arguments=arguments)["result"]
    assert ask("initialize")["result"]["capabilities"] == {"tools": {}} and server.handle({"method": "notifications/initialized"}) is None
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == list(cli.COMMANDS) and len(cli.COMMANDS) == 7
    folder = str(tmp_path / "p")
    assert json.loads(tool("status", folder=folder)["content"][0]["text"]) == {"state": "NEW"}
    assert not tool("init", folder=folder, source=str(src))["isError"]
    for bad in (tool("nope", folder=folder), tool("init", folder=folder), tool("status", folder=folder, extra="1"), tool("status", folder=1), tool("collect", folder=folder, destination=folder)):
        assert bad["isError"]
    assert ask("other")["error"]["code"] == -32601
    out = io.StringIO()
    server.serve(io.StringIO('{"jsonrpc": "2.0", "id": 7, "method": "ping"}\nnot json\n[]\n\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [7, None, None]


def test_server_starts_detached_jobs(tmp_path):
    src = tmp_path / "a.txt"
    src.write_text("x")
    folder = str(tmp_path / "p")
    Project(folder).init(src)
    assert server.start("resume", {"folder": folder, "services": "a:b"})["job"] == "running"
    with pytest.raises(ControlError):
        server.start("resume", {"folder": folder, "services": "a:b"})
    for _ in range(600):
        if (state := server.poll(folder))["job"] != "running":
            break
        time.sleep(0.1)
    assert state["job"] == "failed" and "no run to resume" in state["error"]


def test_blobs_are_written_once_and_verified(spark, tmp_path):
    df = spark.createDataFrame([(b"a",), (b"b",), (b"a",), (None,)], "content binary")
    store = f"file://{tmp_path}/blobs"
    blobs.put(df, store)
    blobs.put(df.union(spark.createDataFrame([(b"c",)], "content binary")), store)
    got = blobs.get(spark, store)
    assert got.count() == 3 and got.where("intact").count() == 3
    (tmp_path / "f.txt").write_text("x")
    assert blobs.digest_files(spark, f"file://{tmp_path}/f.txt").first().size == 1


def test_evidence_catalog(spark, tmp_path):
    row = dict.fromkeys(("source_term", "sense_id", "target_form", "stance", "kind", "tier", "source_key", "source_uri", "source_title", "excerpt", "retrieved_on", "notes"), "x")
    f = tmp_path / "e.json"
    f.write_text(json.dumps({"entries": [row, row, row | {"source_uri": "y"}]}))
    e = evidence.load_catalog(spark, f"file://{f}")
    assert e.count() == 3 and evidence.catalog(e).count() == 1 and evidence.conflicting_sources(e).count() == 1


def test_harvest_needs_the_form_in_the_page(spark):
    c = spark.createDataFrame([("t", "u1", "about Heat flow"), ("t", "u1", "about Heat flow"), ("t", "u2", "none")], "term string, url string, page_text string")
    f = spark.createDataFrame([("t", "heat"), ("t", "cold")], "term string, form string")
    assert [(r.form, r.url) for r in evidence.harvest(c, f).collect()] == [("heat", "u1")]


def test_occurrences_match_a_loop(spark):
    import re

    text = "then the thing, in the then of the and of"
    words = ["then", "the", "thing", "of the", "in"]
    taken = []
    for t in sorted(words, key=lambda t: (-len(t), t)):
        for m in re.finditer(re.escape(t), text):
            if not any(m.start() < e and s < m.end() for s, e, _ in taken):
                taken.append((m.start(), m.end(), t))
    got = terms.occurrences(spark.createDataFrame([(1, text)], "k long, source_text string"), words)
    assert sorted((r.s, r.e, r.term) for r in got.collect()) == sorted(taken)


def test_calls_of_a_stage_do_not_pass_through_the_driver(spark, tmp_path):
    good = lambda r: r.select("call", F.col("x").alias("y"))
    spark.range(50_000).select(F.col("id").cast("string").alias("call"), F.col("id").cast("int").alias("x")).write.parquet(f"{tmp_path}/asked")
    asked = spark.read.parquet(f"{tmp_path}/asked")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    e = Executor(spark, f"file://{tmp_path}/a")
    assert e.execute("s", asked, good, "y int").where("call = y").count() == 50_000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList(before, 1000)
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    assert len(plans) > 4 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert e.execute("s", asked, good, "y int").count() == 50_000 and e.calls == {"s": 50_000}  # nothing is asked again
