"""Queries for whole steps: decisions, adjudication, analysis, artifact verification, a kernel run."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixture
from ..operators import bus, context, gates, ledger, terms
from ..operators.executor import Executor
from ..sources import evidence, records, replies
from ..streaming.folders import drop_cut, shared_folder
from . import publication
from .kernel import Kernel, Services
from .project import Project
from .structure_queries import _CONF, FOUND, PAIRS, _evidence, docs, tab
from .text_queries import LINES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Rules over small typed fixtures: for the tests, not registered.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def case(sql: str):
    def add(f):
        CASES[f.__name__], CASE_SQL[f.__name__] = f, sql
        return f

    return add


FITS = Fixture("k bigint, fit string, n bigint, uri string, want array<string>", [(1, "CONFIRMED", 1, "https://a", []), (2, "CONFIRMED", 0, "urn:x", ["unsupported"]), (3, "UNRESOLVED", 0, "ftp://a", ["uri"]), (4, "REJECTED", 0, None, ["uri"])])


@case(f"SELECT k, want AS problems FROM {FITS.sql}")
def pr13_term_evidence(spark, sf):
    return FITS.df(spark).select("k", terms.evidence_problems(F.col("fit"), F.col("n"), F.col("uri")).alias("problems"))


@query(f"WITH {LINES} SELECT source, max(doc_id) AS page, arg_max(para, (doc_id, para))::INT AS para FROM rec GROUP BY source")
def sp07_locators(spark, sf):
    r = records.segment(docs(spark, sf))
    return r.groupBy("source").agg(F.max(F.struct(F.col("doc_id").alias("page"), "para")).alias("l")).select("source", "l.page", "l.para")


STORED = Fixture("scope string, caps string", [("a", "10/100"), ("b", "20/200")])
INCOMING = Fixture("scope string, caps string", [("a", "10/100"), ("b", "21/200"), ("c", "5/50")])


@case("SELECT * FROM (VALUES ('b', 'conflict'), ('c', 'new')) t(scope, state)")
def st07_budget_policies(spark, sf):
    return ledger.write_once(STORED.df(spark), INCOMING.df(spark), "scope", "caps").where("state <> 'replay'")


@query("SELECT url, count(*) AS n, bool_and(strlen(html) > 0) AS found FROM pages GROUP BY url UNION ALL SELECT 'https://absent.example/', 1, false UNION ALL SELECT 'ftp://absent.example/', 1, false")
def ud05_ud06_fetch(spark, sf):
    p = tab(spark, sf, "pages")
    c = p.select("url").union(spark.createDataFrame([("https://absent.example/",), ("ftp://absent.example/",)], "url string"))
    return evidence.fetch(c, p).groupBy("url").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.length("page_text") > 0, F.lit(False))).alias("found"))


@query("""WITH o AS (SELECT conv_id AS unit, sha256(text) AS option_key FROM conversations), f AS (SELECT DISTINCT conv_id AS unit, sha256(text) AS option_key FROM conversations WHERE role = 'user'),
s AS (SELECT o.unit, min(CASE WHEN f.unit IS NULL THEN o.option_key END) AS selected FROM o LEFT JOIN f ON o.unit = f.unit AND o.option_key = f.option_key GROUP BY o.unit)
SELECT unit, selected, CASE WHEN selected IS NULL THEN 'SYNTHESIZE' ELSE 'SELECT' END AS mode FROM s""")
def pl05_adjudication(spark, sf):
    o, f = _options(spark, sf)
    return bus.adjudicate(o, f)


def _options(spark, sf):
    c = tab(spark, sf, "conversations").select(F.col("conv_id").alias("unit"), F.sha2("text", 256).alias("option_key"), "role", F.concat_ws("-", "conv_id", "turn").alias("finding_id"))
    return c.select("unit", "option_key"), c.select("finding_id", "unit", "option_key", F.when(F.col("role") == "user", "MAJOR").otherwise("INFO").alias("severity"))


@query("""WITH o AS (SELECT conv_id AS unit, sha256(text) AS option_key FROM conversations), f AS (SELECT conv_id || '-' || turn AS finding_id, conv_id AS unit, sha256(text) AS option_key FROM conversations WHERE role = 'user'),
s AS (SELECT o.unit, min(CASE WHEN f.unit IS NULL THEN o.option_key END) AS selected FROM o LEFT JOIN f ON o.unit = f.unit AND o.option_key = f.option_key GROUP BY o.unit)
SELECT finding_id, CASE WHEN selected IS NOT NULL AND option_key <> selected THEN 'AVOIDED' ELSE 'CORRECTED' END AS action FROM f JOIN s USING (unit)""")
def pl19_resolutions(spark, sf):
    o, f = _options(spark, sf)
    return bus.resolutions(bus.adjudicate(o, f), f)


@query(f"""WITH {_CONF}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY CASE conventionality WHEN 'UNATTESTED' THEN 0 WHEN 'ATTESTED' THEN 2 ELSE 3 END DESC, evidence_rank DESC, form DESC) AS i FROM conf WHERE sources > 0),
t AS (SELECT DISTINCT term FROM conf), d AS (SELECT t.term, coalesce(r.form, t.term) AS form, coalesce(r.confidence, 'RETAINED_UNRESOLVED') AS confidence FROM t LEFT JOIN r ON t.term = r.term AND r.i = 1)
SELECT *, CASE confidence WHEN 'VERIFIED' THEN 'TRANSLATE_ONLY' WHEN 'RETAINED_UNRESOLVED' THEN 'RETAIN_SOURCE' ELSE 'TRANSLATE_WITH_SOURCE_FIRST' END AS treatment FROM d""")
def pl12_term_decisions(spark, sf):
    e = _evidence(spark, sf)
    fit = F.when(F.max(F.col("sense_match") & F.col("domain_match") & (F.col("stance") == "SUPPORTS")), "CONFIRMED").otherwise("UNRESOLVED")
    return terms.decide(e, e.groupBy("term", "form").agg(fit.alias("fit"), F.lit(False).alias("selected"), F.lit("").alias("override")))


def _analyse(pdf):
    return pdf.assign(reply=pdf.text.map(lambda t: len(t.split(" "))))[["doc_id", "chunk", "reply"]]


@query(f"""WITH RECURSIVE {LINES}, w AS (SELECT doc_id, list(source_text ORDER BY para) AS ts FROM rec GROUP BY doc_id),
f AS (SELECT doc_id, ts, 1 AS i, 0::BIGINT AS used, 0 AS chunk, 0::BIGINT AS total FROM w UNION ALL
  SELECT doc_id, ts, i + 1, CASE WHEN used > 0 AND used + length(ts[i]) > 2000 THEN length(ts[i]) ELSE used + length(ts[i]) END, CASE WHEN used > 0 AND used + length(ts[i]) > 2000 THEN chunk + 1 ELSE chunk END, total + len(string_split(ts[i], ' ')) FROM f WHERE i <= len(ts))
SELECT doc_id, chunk::BIGINT + 1 AS n_chunks, total AS words, chunk > 0 AS needs_synthesis FROM f WHERE i = len(ts) + 1""")
def pl11_analysis(spark, sf):
    """Chunk, analyse each chunk by an injected service, merge; more than one chunk needs a synthesis."""
    services = bus.Registry()
    services.add("analyse", "doc_id long, chunk int, reply long")(_analyse)
    r = records.segment(docs(spark, sf)).withColumn("n", F.length("source_text"))
    parts = context.chunks(r, limit=2000).join(r.select("doc_id", "para", "source_text"), ["doc_id", "para"])
    texts = parts.groupBy("doc_id", "chunk").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("para", "source_text"))), lambda x: x["source_text"])).alias("text"))
    return services.call("analyse", texts).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("reply").alias("words"), (F.count("*") > 1).alias("needs_synthesis"))


@case(f"SELECT 'artifact' AS report, count(*) AS n_findings, list_sort(list(DISTINCT category)) AS categories, 'BLOCK' AS verdict FROM {FOUND.sql}")
def pl16_verify_artifact(spark, sf):
    f = gates.page_findings(PAIRS.df(spark)).withColumn("report", F.lit("artifact"))
    r = gates.report(f, "report")
    return r.select("report", F.size("findings").cast("long").alias("n_findings"), F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["category"]))).alias("categories"), "verdict")


@query(f"""WITH {LINES}, b AS (SELECT a.doc_id, a.para, string_agg(sha256(c.source_text), ',' ORDER BY c.para) AS t FROM rec a JOIN rec c ON a.doc_id = c.doc_id AND c.para BETWEEN a.para - 2 AND a.para - 1 GROUP BY ALL),
f AS (SELECT a.doc_id, a.para, string_agg(sha256(c.source_text), ',' ORDER BY c.para) AS t FROM rec a JOIN rec c ON a.doc_id = c.doc_id AND c.para BETWEEN a.para + 1 AND a.para + 2 GROUP BY ALL)
SELECT rec.doc_id, rec.para::INT AS para, coalesce(b.t, '') AS before, coalesce(f.t, '') AS after FROM rec LEFT JOIN b ON rec.doc_id = b.doc_id AND rec.para = b.para LEFT JOIN f ON rec.doc_id = f.doc_id AND rec.para = f.para""")
def pl21_context_rows(spark, sf):
    r = records.segment(docs(spark, sf))
    c = context.context_rows(context.context_windows(r, before=2, after=2, budget=10**9), r)
    joined = lambda side: F.concat_ws(",", F.transform(side, lambda x: F.sha2(x["t"], 256)))
    return c.select("doc_id", "para", joined("before").alias("before"), joined("after").alias("after"))


# Whole runs with injected services: every lane answers with the source between its name and a mark.

_FINDINGS = "array<struct<finding_id:string,option_key:string,severity:string,message:string>>"


def _services() -> Services:
    """Baseline texts get a serious finding where the source has a comma, so the other lane must be selected; an edit adds a mark."""

    def review(r):
        bad = F.filter("options", lambda o: o["target_text"].endswith("|baseline") & (F.size("options") > 1) & F.contains("source_text", F.lit(",")))
        found = F.transform(bad, lambda o: F.struct(F.concat(F.lit("f:"), F.col("unit")).alias("finding_id"), o["option_key"].alias("option_key"), F.lit("MAJOR").alias("severity"), F.lit("comma").alias("message")))
        return r.select("call", found.alias("findings"))

    passed = lambda r: r.select("call", F.lit("PASS").alias("verdict"), F.array().cast("array<string>").alias("notes"))
    return Services(
        generate=lambda r: r.select("call", F.concat("source_text", F.lit("|"), "lane").alias("target_text")),
        review=review,
        edit=lambda r: r.select("call", F.concat("target_text", F.lit("!")).alias("edited_text"), F.lit("IMPROVES").alias("impact")),
        verify=lambda r: r.select("call", F.array().cast(_FINDINGS).alias("findings")),
        review_document=passed,
        synthesize=passed,
    )


_RUN = f"""{LINES}, u AS (SELECT doc_id, para, source_text, disposition, regexp_matches(source_text, '(^|[^A-Za-z])\\d') OR (lang = 'en' AND regexp_matches(lower(source_text),
  '(^|\\W)(not|no|never|neither|unless|except|only|must|shall|should|may|might|can|cannot|could|would|at\\s+least|at\\s+most|more\\s+than|less\\s+than|respectively)($|\\W)')) AS risky FROM rec),
c AS (SELECT *, unnest(CASE WHEN risky THEN ['baseline', 'alternative'] ELSE ['baseline'] END) AS lane FROM u WHERE disposition = 'translatable'),
o AS (SELECT *, source_text || '|' || lane AS t, sha256('{{"namespace":"ledgerloom.option/1","payload":{{"candidate":"' || sha256(doc_id || ':' || para || chr(10) || lane || chr(10) || source_text || '|' || lane) || '","unit":"' || doc_id || ':' || para || '"}}}}') AS k FROM c),
best AS (SELECT doc_id, para, arg_min(t, k) FILTER (NOT (risky AND lane = 'baseline' AND contains(source_text, ','))) AS t FROM o GROUP BY doc_id, para)"""


@query(f"WITH {_RUN} SELECT doc_id || ':' || para AS unit, sha256(t || '!') AS edited_sha FROM best")
def pl01_pl02_pl05_kernel_run(spark, sf):
    """A run of the bus over all units: candidates per lane, blind options, review, selection, edit, verification, document review."""
    table = publication.units_table(docs(spark, sf))
    units = table.where("disposition = 'translatable'")
    kernel = Kernel(spark, Executor(spark, shared_folder(spark, "run")), _services(), 2000)
    out = kernel.run(publication.routes_of(units), units.select("unit", "doc_id", "pos", "source_text"))
    drop_cut(table)
    return out.select("unit", F.sha2("edited_text", 256).alias("edited_sha"))


@query(f"""WITH {_RUN}, f AS (SELECT u.doc_id, string_agg(CASE WHEN u.disposition = 'translatable' THEN best.t || '!' ELSE u.source_text END, chr(10) ORDER BY u.para) AS text
  FROM u LEFT JOIN best ON best.doc_id = u.doc_id AND best.para = u.para GROUP BY u.doc_id) SELECT doc_id, sha256(text) AS text_sha, 'PASS' AS verdict, 'RELEASED' AS state FROM f""")
def pl10_pl14_pl15_publication(spark, sf):
    """Documents to verified texts, twice: the second run renders what the first released and calls nothing."""
    with tempfile.TemporaryDirectory() as control:  # the driver's small control files; tables are in the shared folder
        source = Path(control) / "source.txt"
        source.write_text(sf)
        project = Project(Path(control) / "project")
        project.init(source)
        folder = shared_folder(spark, "publication")
        first = publication.Publication(spark, folder, project, _services()).run(docs(spark, sf))
        again = publication.Publication(spark, folder, project, _services())
        second = again.run(docs(spark, sf))
        if not first.capture_needed or second.capture_needed or sum(again.executor.calls.values()) or second.release != first.release:
            raise RuntimeError("the second run must render the first release without a call")
        return second.text.select("doc_id", F.sha2("text", 256).alias("text_sha"), F.lit(second.report["verdict"]).alias("verdict"), F.lit(project.status()).alias("state"))


@query(f"""WITH {_RUN}, n AS (SELECT count(*) AS units, count(DISTINCT doc_id) AS docs FROM best),
w AS (SELECT doc_id, list(length(t) + 1 ORDER BY para) AS ns FROM best GROUP BY doc_id)
SELECT stage, calls, 0::BIGINT AS again FROM (SELECT 'generate' AS stage, (SELECT count(*) FROM c) AS calls UNION ALL SELECT unnest(['review', 'adjudicate', 'edit', 'verify']), units FROM n UNION ALL SELECT 'review_document', docs FROM n UNION ALL SELECT 'synthesize', 0)""")
def ud03_ud09_calls(spark, sf):
    """Calls of a run by stage, and of a second run over the same folder; documents are reviewed in one chunk each."""
    table = publication.units_table(docs(spark, sf))
    units = table.where("disposition = 'translatable'")
    folder, counts = shared_folder(spark, "run"), []
    for _ in range(2):
        e = Executor(spark, folder)
        Kernel(spark, e, _services(), 10**9).run(publication.routes_of(units), units.select("unit", "doc_id", "pos", "source_text"))
        counts.append(e.calls)
    drop_cut(table)
    return spark.createDataFrame([(k, n, counts[1][k]) for k, n in counts[0].items()], "stage string, calls long, again long")


_SAID = "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'timeout' WHEN 'signup' THEN 'rate_limit' WHEN 'purchase' THEN NULL ELSE 'invalid' END"


@query(f"""WITH s AS (SELECT event_id, {_SAID} AS error, event_id % 3 + 1 AS k FROM events WHERE event_type <> 'error')
SELECT event_id, least(CASE WHEN error IS NULL THEN 1 ELSE k END, 3)::INT AS attempts, CASE WHEN error IS NULL OR k <= 3 THEN 'SUCCEEDED' END AS status FROM s""")
def st02_st06_executor(spark, sf):
    """Events as calls of a service that times out or is rate limited for up to two attempts, then answers."""
    e = tab(spark, sf, "events").where("event_type <> 'error'")
    said = F.when(F.col("event_type") == "click", "timeout").when(F.col("event_type") == "signup", "rate_limit")
    requests = e.select(F.col("event_id").cast("string").alias("call"), "event_id", said.alias("says"), (F.col("event_id") % 3 + 1).alias("k"))
    waits = []
    ex = Executor(spark, shared_folder(spark, "calls"), sleep=waits.append)

    def service(r):
        tried = ex.attempts().groupBy("call").agg(F.max("ordinal").alias("o"))
        j = r.join(tried, "call")
        return j.select("call", F.col("event_id").alias("reply"), F.when(F.col("o") < F.col("k"), F.col("says")).alias("error"), F.when(F.col("says") == "rate_limit", 5.0).alias("retry_after"))

    ex.execute("answer", requests, service, "reply long")
    if waits != [5.0, 5.0]:
        raise RuntimeError(f"waits {waits}")
    return ex.status().select(F.col("call").cast("long").alias("event_id"), F.col("n_attempts").cast("int").alias("attempts"), "status")


@query(r"""WITH p AS (SELECT conv_id, turn, text, turn % 4 AS kind FROM conversations)
SELECT conv_id, CASE WHEN conv_id % 17 <> 0 AND t <> '' THEN t END AS text, CASE WHEN conv_id % 17 = 0 THEN NULL WHEN t <> '' THEN n END AS notes, CASE WHEN conv_id % 13 = 0 THEN 'no output' WHEN conv_id % 17 = 0 THEN 'refusal' WHEN t = '' THEN 'no text' END AS problem
FROM (SELECT conv_id, coalesce(regexp_replace(string_agg(CASE WHEN kind < 2 AND conv_id % 13 <> 0 THEN text END, '' ORDER BY turn), '^\s+|\s+$', '', 'g'), '') AS t, count(*) FILTER (kind = 1 AND conv_id % 13 <> 0) AS n FROM p GROUP BY conv_id)""")
def ud08_reply_text(spark, sf):
    """Conversations as model replies: message parts, parts with a citation, parts of other kinds, refusals, replies without output."""
    kind = F.col("turn") % 4
    note = F.array(F.create_map(F.lit("type"), F.lit("url_citation"), F.lit("url"), F.concat(F.lit("https://a/"), F.col("turn"))))
    part = F.struct(F.when(kind == 3, "other").otherwise("output_text").alias("type"), F.col("text").alias("text"), F.when(kind == 1, note).alias("annotations"))
    refusal = F.struct(F.lit("refusal").alias("type"), F.lit("no").alias("text"), F.lit(None).cast("array<map<string,string>>").alias("annotations"))
    item = F.struct(F.when(kind == 2, "reasoning").otherwise("message").alias("type"), F.array(part).alias("content"))
    c = tab(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", item.alias("item"))).alias("items"))
    items = F.transform(F.array_sort("items", lambda a, b: F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)), lambda x: x["item"])
    refused = F.concat(items, F.array(F.struct(F.lit("message").alias("type"), F.array(refusal).alias("content"))))
    output = F.when(F.col("conv_id") % 13 != 0, F.when(F.col("conv_id") % 17 == 0, refused).otherwise(items))
    r = c.select("conv_id", replies.flatten(F.to_json(F.struct(output.alias("output")))).alias("r"))
    return r.select("conv_id", "r.text", F.size("r.annotations").cast("long").alias("notes"), "r.problem")


@query("SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'fields' WHEN 2 THEN 'fields' WHEN 3 THEN 'types' WHEN 4 THEN 'no object' END AS problem, CASE WHEN event_id % 5 = 0 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events")
def ud05_structured(spark, sf):
    """Properties of events against their schema: as they are, without a field, with another, of another type, cut off."""
    i, k = F.col("event_id") % 5, F.get_json_object("props", "$.k")
    text = F.when(i == 0, F.concat(F.lit('{"k":'), k, F.lit(',"by":"u"}'))).when(i == 1, F.concat(F.lit('{"k":'), k, F.lit("}"))).when(i == 2, F.concat(F.lit('{"k":'), k, F.lit(',"by":"u","x":1}')))
    text = text.when(i == 3, F.lit('{"k":"many","by":"u"}')).otherwise(F.concat(F.lit('{"k":'), k))
    r = tab(spark, sf, "events").select("event_id", replies.structured(text, "k long, by string").alias("r"))
    return r.select("event_id", "r.problem", F.col("r.value.k").alias("k"))
