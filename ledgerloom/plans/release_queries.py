"""Queries over budgets in rounds, quoted reviews, laid-out pages and differences of releases, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bus, constraints, digest_tree, gates, ledger
from ..operators.executor import Busy, Executor
from ..sources import layout, records
from ..streaming.folders import shared_folder, shuffles_dropped
from .text_queries import LINES, docs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""WITH RECURSIVE e AS (SELECT event_type, event_id, floor(value * 100)::BIGINT AS c, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT event_type, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::BIGINT AS spent, false AS admitted FROM e
  UNION ALL SELECT e.event_type, e.i, e.event_id, CASE WHEN r.spent + e.c <= 500000 THEN r.spent + e.c ELSE r.spent END, r.spent + e.c <= 500000 FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1)
SELECT event_type, event_id, admitted, spent FROM r WHERE i > 0""")
def wn06_budget_rounds(spark, sf):
    """Five budgets for all events, each of a fifth of the rows: admission by rounds of running sums, spread over all tasks."""
    e = records.read_table(spark, sf, "events").withColumn("c", F.floor(F.col("value") * 100).cast("long"))
    return ledger.admit_in_rounds(e, "event_type", ["ts", "event_id"], "c", 500_000).select("event_type", "event_id", "admitted", "spent")


_SPAN = "struct<s:int,e:int,quoted:string>"


@query(r"""WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS opt FROM conversations),
f AS (SELECT *, regexp_extract(text, '^[^\s]+') AS id, regexp_extract(opt, '[^\s]+$') AS w, CASE WHEN regexp_matches(opt, '[^\s]$') AND NOT contains(text, 'w') THEN length(opt) - length(regexp_extract(opt, '[^\s]+$')) - CASE WHEN contains(text, 'z') THEN 1 ELSE 0 END END AS s FROM t),
q AS (SELECT *, s IS NOT NULL AND (s < 0 OR substring(opt, s + 1, length(w)) <> w) AS wrong FROM f)
SELECT conv_id, list_filter([CASE WHEN bool_or(opt IS NULL) THEN 'unknown option' END, CASE WHEN count(DISTINCT id) < count(*) THEN 'repeated finding' END, CASE WHEN bool_or(wrong) THEN 'citation' END, CASE WHEN bool_or(role = 'assistant' AND s IS NULL) THEN 'uncited' END], lambda x: x IS NOT NULL) AS problems FROM q GROUP BY conv_id""")
def pr15_pl04_quoted_reviews(spark, sf):
    """Turns as findings about the next turn, named by their first word.

    They quote its last word at its place, those with a z in their text a place before it, those with a w not at all.
    """
    c = records.read_table(spark, sf, "conversations")
    t = c.withColumn("opt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("w", F.regexp_extract("opt", r"[^\s]+$", 0))
    s = F.length("opt") - F.length("w") - F.contains("text", F.lit("z")).cast("int")
    span = F.when((F.col("w") != "") & ~F.contains("text", F.lit("w")), F.struct(s.alias("s"), (s + F.length("w")).alias("e"), F.col("w").alias("quoted")).cast(_SPAN))
    key = F.when(F.col("opt").isNotNull(), (F.col("turn") + 1).cast("string")).otherwise("none")
    name = F.regexp_extract("text", r"^[^\s]+", 0).alias("finding_id")
    found = F.struct(name, key.alias("option_key"), F.when(F.col("role") == "assistant", "MAJOR").otherwise("MINOR").alias("severity"), F.lit("m").alias("message"), F.lit(None).cast(_SPAN).alias("source_span"), span.alias("target_span"))
    per = t.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("string").alias("option_key"), F.col("text").alias("target_text"))).alias("options"), F.collect_list(found).alias("findings"))
    return per.select("conv_id", constraints.review_problems(F.col("options"), F.col("findings"), F.lit(""), True).alias("problems"))


@query(r"""WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang IS DISTINCT FROM 'de' AND text IS NOT NULL),
a AS (SELECT doc_id, sha256(regexp_replace(text, '[\x20\x09\x0a\x0d]+', ' ', 'g')) AS h FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def pr24_ag10_release_difference(spark, sf):
    """Two releases of all documents, the second with white space made one and poor documents left out, the first without German: what differs, by their digest trees."""
    d = docs(spark, sf).where("text IS NOT NULL")
    as_outcomes = lambda df, text: df.select("doc_id", F.lit(0).alias("pos"), F.sha2(text, 256).alias("outcome_id"))
    poor = records.read_table(spark, sf, "labels").where("quality = 0").select("doc_id")
    before = as_outcomes(d.where(~F.col("lang").eqNullSafe("de")), F.col("text"))
    after = as_outcomes(d.join(poor, "doc_id", "left_anti"), F.regexp_replace("text", r"[\x20\x09\x0a\x0d]+", " "))
    places = [shared_folder(spark, "tree") for _ in range(2)]
    for outcomes, place in zip((before, after), places, strict=True):
        digest_tree.store(outcomes, place)
    return digest_tree.difference(spark, *places)[0]


@query(f"""WITH {LINES}, p AS (SELECT coalesce(d.source, 'none') AS part, rec.doc_id, (rec.para // 40)::INT AS page, (rec.para % 40)::INT AS para, rec.source_text FROM rec JOIN documents d ON d.doc_id = rec.doc_id),
k AS (SELECT *, sha256('{{"namespace":"ledgerloom.place/1","payload":{{"doc":"' || doc_id || '","page":' || page || ',"para":' || para || ',"part":"' || part || '"}}}}') AS key FROM p)
SELECT part, doc_id, page, count(*) AS n, count(*) FILTER (source_text <> '') AS boxes, sum(length(source_text))::BIGINT AS characters, sha256(string_agg(key, chr(10) ORDER BY para)) AS keys FROM k GROUP BY part, doc_id, page""")
def src11_layout_pages(spark, sf):
    """All documents as pages of forty lines with boxes, written and read by the layout source, where every key is proved."""
    d = docs(spark, sf)
    lines = records.segment(d).join(d.select("doc_id", F.coalesce("source", F.lit("none")).alias("part")), "doc_id")
    n = F.length("source_text").cast("double")
    box = F.when(n > 0, F.struct(F.lit(0.0).alias("x0"), (F.col("para") % 40 * 10.0).alias("y0"), n.alias("x1"), (F.col("para") % 40 * 10.0 + 8).alias("y1")))
    pages = lines.select(
        "part", "doc_id", F.expr("int(para div 40)").alias("page"), F.lit(600.0).alias("width"), F.lit(400.0).alias("height"), (F.col("para") % 40).alias("para"),
        F.col("source_text").alias("text"), F.lit(False).alias("vertical"), box.alias("box"),
    )
    folder = shared_folder(spark, "layout")
    layout.write(pages, folder)
    keys = F.transform(F.array_sort(F.collect_list(F.struct("para", "record_key"))), lambda r: r["record_key"])
    return layout.read(spark, folder).groupBy("part", "doc_id", "page").agg(
        F.count("*").alias("n"), F.count("box").alias("boxes"), F.sum(F.length("text")).alias("characters"), F.sha2(F.array_join(keys, "\n"), 256).alias("keys")
    )


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{4,}') AS first FROM documents), t AS (SELECT a.doc_id, a.first, coalesce(b.text, '') AS t FROM w a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, list_filter([CASE WHEN regexp_replace(t, '^[\s\x{0b}\x{85}\x{a0}]+', '') = '' THEN 'blank' END, CASE WHEN regexp_matches(t, '[\x00-\x08\x0b-\x1f\x7f\x{80}-\x{9f}]') THEN 'control character' END,
  CASE WHEN coalesce(first, '') <> '' AND strpos(t, first) = 0 THEN 'rendering' END], lambda x: x IS NOT NULL) AS problems FROM t""")
def pl01_pr08_pr14_refused_texts(spark, sf):
    """The next document as target of each: what a run would refuse it for, if the first long word had to stand in it."""
    d = docs(spark, sf)
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("t"))
    first = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]{4,}", 0)
    none = F.array().cast("array<struct<occurrence_key:string,required:string>>")
    asked = F.when(F.col("first") != "", F.array(F.struct(F.lit("k").alias("occurrence_key"), F.col("first").alias("required")))).otherwise(none)
    j = d.select("doc_id", first.alias("first")).join(after, "doc_id", "left").withColumn("t", F.coalesce("t", F.lit(""))).withColumn("asked", asked)
    return j.select("doc_id", F.concat(constraints.target_problems(F.col("t")), constraints.directive_problems(F.col("t"), F.col("asked"))).alias("problems"))


@query("""WITH u AS (SELECT o_orderkey AS k, o_orderstatus AS want FROM orders), r AS (SELECT l_orderkey AS k, max(l_linestatus) AS got, list(DISTINCT l_suppkey) AS lanes FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1),
a AS (SELECT s_nationkey AS actor, 'TRANSLATOR' AS role FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT c_nationkey, 'BILINGUAL_REVIEWER' FROM customer WHERE c_acctbal > 9900)
SELECT CASE WHEN r.k IS NULL THEN 'missing' WHEN u.k IS NULL THEN 'extra' ELSE 'stale' END AS problem, coalesce(u.k, r.k)::VARCHAR AS subject FROM u FULL JOIN r ON u.k = r.k WHERE r.k IS NULL OR u.k IS NULL OR got <> want
UNION ALL SELECT DISTINCT 'unknown lane', l::VARCHAR FROM (SELECT unnest(lanes) AS l FROM r) WHERE l NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'shared actor', actor::VARCHAR FROM a GROUP BY actor HAVING count(DISTINCT role) = 2
UNION ALL SELECT 'repeated lane', s_suppkey::VARCHAR FROM supplier GROUP BY s_suppkey HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'repeated actor', actor::VARCHAR FROM (SELECT actor, role FROM a GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT DISTINCT 'lane without translator', s_suppkey::VARCHAR FROM supplier WHERE s_nationkey NOT IN (SELECT actor FROM a WHERE role = 'TRANSLATOR')""")
def pr10_order_plans(spark, sf):
    """Orders as units whose revision is their status, their suppliers as lanes, nations as actors: translators have suppliers in credit, reviewers rich customers."""
    t = lambda n: records.read_table(spark, sf, n)
    units = t("orders").select(F.col("o_orderkey").alias("unit_key"), F.col("o_orderstatus").alias("unit_revision"))
    routes = t("lineitem").where("l_shipdate IS NOT NULL").groupBy(F.col("l_orderkey").alias("unit_key")).agg(F.max("l_linestatus").alias("unit_revision"), F.collect_set(F.col("l_suppkey").cast("string")).alias("lane_keys"))
    lanes = t("supplier").select(F.col("s_suppkey").cast("string").alias("lane_key"), F.col("s_nationkey").cast("string").alias("actor_key"))
    able = t("supplier").where("s_acctbal > 0").select(F.col("s_nationkey").cast("string").alias("actor_key"), F.lit("TRANSLATOR").alias("role"))
    actors = able.unionByName(t("customer").where("c_acctbal > 9900").select(F.col("c_nationkey").cast("string").alias("actor_key"), F.lit("BILINGUAL_REVIEWER").alias("role")))
    return constraints.plan_problems(routes, units, lanes, actors).unionByName(constraints.cast_problems(lanes, actors))


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, list(event_type ORDER BY event_id) AS ts_, list(CAST(floor(value) AS BIGINT) ORDER BY event_id) AS ps FROM events GROUP BY 1, 2)
SELECT user_id, day, list_filter([CASE WHEN len(list_distinct(ts_)) > 1 THEN 'other term' END, CASE WHEN len(list_distinct(ps)) < len(ps) THEN 'repeated' END, CASE WHEN list_sort(ps) <> ps THEN 'order' END], lambda x: x IS NOT NULL) AS problems FROM g""")
def pr12_event_occurrences(spark, sf):
    """A user's events of a day as occurrences of their type at the place of their value."""
    e = records.read_table(spark, sf, "events")
    rows = F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("term"), F.floor("value").cast("long").alias("at"))))
    per = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(rows.alias("o"))
    return per.select("user_id", "day", constraints.occurrence_problems(F.transform("o", lambda o: o.dropFields("event_id"))).alias("problems"))


@query(f"""WITH {LINES}, o AS (SELECT doc_id, count(*) AS n, sha256(string_agg(sha256(source_text), chr(10) ORDER BY para)) AS h FROM rec GROUP BY doc_id),
d AS (SELECT doc_id, list_transform(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]{{1,3}}')), lambda x: x::BIGINT) AS cited FROM documents), l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT o.doc_id, list_filter([CASE WHEN s.h IS DISTINCT FROM o.h THEN 'outcome set' END, CASE WHEN len(list_filter(cited, lambda x: x >= o.n)) > 0 THEN 'unknown unit' END, CASE WHEN (coalesce(quality, 1) = 1) = coalesce(toxic = 1, false) THEN 'verdict' END], lambda x: x IS NOT NULL) AS problems
FROM o LEFT JOIN o s ON s.doc_id = o.doc_id - 1 JOIN d ON d.doc_id = o.doc_id LEFT JOIN l ON l.doc_id = o.doc_id""")
def pr18_document_verdicts(spark, sf):
    """Documents with the outcome set of the one before them, which copies share; the numbers in a text are the units it cites; good ones are passed, toxic ones have serious findings."""
    d = docs(spark, sf)
    lines = records.segment(d).select("doc_id", "para", F.sha2("source_text", 256).alias("outcome_id"))
    own = bus.outcome_set(lines)
    said = own.select((F.col("doc_id") + 1).alias("doc_id"), F.col("outcome_set_id").alias("said"))
    labels = records.read_table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    cited = F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]{1,3}"), F.lit(0))), lambda x: x.cast("long"))
    j = own.join(said, "doc_id", "left").join(d.select("doc_id", cited.alias("cited")), "doc_id").join(labels, "doc_id", "left")
    verdict = F.when(F.coalesce("quality", F.lit(1)) == 1, "PASS").otherwise("BLOCK")
    known = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    return j.select("doc_id", constraints.document_verdict_problems(verdict, F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("said"), F.col("outcome_set_id"), F.col("cited"), known).alias("problems"))


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS source_pages, count(*) FILTER (role <> 'user') AS target_pages FROM conversations WHERE role IS NOT NULL GROUP BY conv_id)
SELECT *, 'PAGE_COUNT' AS category, 'BLOCKING' AS severity FROM c WHERE source_pages <> target_pages""")
def pl16_page_counts(spark, sf):
    """Turns of users as source pages, all others as target pages: conversations that the gate stops before any page is compared."""
    c = records.read_table(spark, sf, "conversations").where("role IS NOT NULL")
    return gates.page_count_findings(c.where("role = 'user'"), c.where("role <> 'user'"), "conv_id")


@query("""WITH n AS (SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1), l AS (SELECT stage, n, unnest(CASE WHEN stage = 'error' THEN
  [{'epoch': 1, 'owner': 'one', 'event': 'ACQUIRED'}, {'epoch': 1, 'owner': 'one', 'event': 'EXPIRED'}, {'epoch': 2, 'owner': 'two', 'event': 'ACQUIRED'}, {'epoch': 2, 'owner': 'two', 'event': 'RELEASED'}]
  ELSE [{'epoch': 1, 'owner': 'one', 'event': 'ACQUIRED'}, {'epoch': 1, 'owner': 'one', 'event': 'RELEASED'}] END) AS e FROM n)
SELECT stage, e.epoch::BIGINT AS epoch, e.owner AS owner, e.event AS event, n * CASE WHEN stage = 'error' THEN 2 ELSE 1 END AS attempts, n AS replies FROM l""")
def st03_st04_lease_log(spark, sf):
    """Events as calls, a stage a type: one owner dies over the errors, another takes its lease when that has run out, and what the first says then is refused."""
    e = records.read_table(spark, sf, "events").select(F.col("event_id").cast("string").alias("call"), "event_type", "event_id")
    folder, now = shared_folder(spark, "calls"), [datetime(2024, 1, 1, tzinfo=timezone.utc)]
    one, two = (Executor(spark, folder, owner=o, lease_seconds=10, clock=lambda: now[0]) for o in ("one", "two"))
    answer = lambda r: r.select("call", F.col("event_id").alias("reply"))
    out = None
    for stage in sorted(r.event_type for r in e.select("event_type").distinct().collect()):
        asked = e.where(F.col("event_type") == stage).drop("event_type")

        def dies(r, stage=stage, asked=asked):
            if stage == "error":
                now[0] += timedelta(seconds=11)
                two.execute(stage, asked, answer, "reply long")
            return answer(r)

        try:
            with shuffles_dropped(spark):
                one.execute(stage, asked, dies, "reply long")
        except Busy:
            if stage != "error":
                raise
        row = two.attempts(stage).groupBy("stage").agg(F.count("*").alias("attempts"))
        said = two.results(stage, "reply long").agg(F.count("*").alias("replies")).withColumn("stage", F.lit(stage))
        row = row.join(said, "stage")
        out = row if out is None else out.unionByName(row)
    return two.lease_log().select("stage", "epoch", "owner", "event").join(out, "stage")
