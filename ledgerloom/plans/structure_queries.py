"""Queries for constraints, terms, context, ledgers, the review bus and gates, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import Fixture
from ..functions import identity as ids
from ..functions import text as tx
from ..functions import values as vl
from ..operators import bus, constraints, context, gates, ledger, terms
from ..sources import records
from .text_queries import LINES, _KEY, _REV, _WS, _anchors_sql, docs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Rules over small typed fixtures with the answers beside them: for the tests, not registered.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def case(sql: str):
    def add(f):
        CASES[f.__name__], CASE_SQL[f.__name__] = f, sql
        return f

    return add


def units(spark, sf) -> DataFrame:
    return records.segment(docs(spark, sf)).where("disposition = 'translatable'")


def tab(spark, sf, name) -> DataFrame:
    return records.read_table(spark, sf, name)


# --- constraints -------------------------------------------------------------------------------

NS = "PT2-0123456789ab"
O, C, FM = f"[[{NS}:S:0001:OPEN]]", f"[[{NS}:S:0001:CLOSE]]", f"[[{NS}:F:0002]]"
DAMAGE = Fixture("k bigint, t string, want array<string>", [
    (1, f"a {O}bold{C} and {FM}.", []), (2, f"a {O}bold{C} and.", ["count", "invented"]), (3, f"a {O}bold{C} {FM} {FM}", ["count", "invented"]),
    (4, f"{O}x{C} {FM} [[{NS}:F:0009]]", ["invented"]), (5, f"{FM} {O}x{C}", ["order"]), (6, f"{O}  {C} {FM}", ["empty style"]),
    (7, f"{C}x{O} {FM}", ["order", "empty style"]), (8, f"{O}x{C} {FM} [[{NS}:F:00", ["unterminated"]),
])


def _specs():
    s = lambda k, o, c: F.struct(F.lit(k).alias("kind"), F.lit(o).alias("open_token"), F.lit(c).cast("string").alias("close_token"))
    return F.array(s("rich_style", O, C), s("formula", FM, None))


@case(f"SELECT k, want AS problems FROM {DAMAGE.sql}")
def pr01_placeholder_damage(spark, sf):
    return DAMAGE.df(spark).select("k", constraints.placeholder_problems(F.col("t"), F.lit(NS), _specs()).alias("problems"))


CONTRACTS = Fixture("k bigint, ns string, a string, b string, want array<string>", [
    (1, NS, O, C, []), (2, "PT2-xyz", O, C, ["namespace", "token shape"]), (3, NS, O, O, ["tokens repeat", "token shape"]),
    (4, NS, O, f"[[{NS}:S:0002:CLOSE]]", ["token shape"]), (5, NS, FM, None, ["token shape"]),
])


@case(f"SELECT k, want AS problems FROM {CONTRACTS.sql}")
def pr02_placeholder_contract(spark, sf):
    specs = F.array(F.struct(F.lit("rich_style").alias("kind"), F.col("a").alias("open_token"), F.col("b").alias("close_token")))
    return CONTRACTS.df(spark).select("k", constraints.contract_problems(F.col("ns"), specs).alias("problems"))


RECORDS = Fixture("k bigint, d string, r string, unit boolean, box boolean, vert boolean, want array<string>", [
    (1, "translatable", "TEXT", True, True, False, []), (2, "translatable", "EMPTY", True, True, False, ["reason"]), (3, "safe_exclusion", "PURE_NUMERIC", True, True, False, ["unit"]),
    (4, "blocker", "MISSING_GEOMETRY", False, True, False, ["box"]), (5, "blocker", "VERTICAL_TEXT_UNSUPPORTED", False, True, False, ["vertical"]), (6, "translatable", "TEXT", False, False, False, ["unit", "box"]),
])


@case(f"SELECT k, want AS problems FROM {RECORDS.sql}")
def pr03_record_rules(spark, sf):
    c = F.col
    return RECORDS.df(spark).select("k", constraints.record_problems(c("d"), c("r"), c("unit"), c("box"), c("vert")).alias("problems"))


@query(rf"WITH {LINES} SELECT doc_id, count(*) AS blockers FROM rec WHERE regexp_matches(source_text, '\d') GROUP BY doc_id")
def pr05_blockers(spark, sf):
    """Paragraphs with digits taken for blockers: the documents that they stop."""
    r = records.segment(docs(spark, sf)).withColumn("disposition", F.when(F.col("source_text").rlike(r"\d"), "blocker").otherwise(F.col("disposition")))
    return constraints.blocked(r, "doc_id")


# Approvals: each turn of a conversation is a revision of its unit; the documents are the units.
@query("""WITH e AS (SELECT doc_id AS unit_key, n_chars AS rev FROM documents), a AS (SELECT conv_id AS unit_key, count(*) AS n, max(strlen(text)) AS got FROM conversations GROUP BY conv_id)
SELECT coalesce(e.unit_key, a.unit_key) AS unit_key, CASE WHEN n IS NULL THEN 'missing' WHEN rev IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' WHEN got <> rev THEN 'stale' END AS problem
FROM e FULL JOIN a ON e.unit_key = a.unit_key WHERE n IS NULL OR rev IS NULL OR n > 1 OR got <> rev""")
def pr06_se01_exact_cover(spark, sf):
    e = tab(spark, sf, "documents").select(F.col("doc_id").alias("unit_key"), F.col("n_chars").alias("rev"))
    a = tab(spark, sf, "conversations").select(F.col("conv_id").alias("unit_key"), F.octet_length("text").cast("long").alias("rev"))
    return constraints.exact_cover(e, a, "unit_key", "rev")


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id)")
def pr07_foreign_approvals(spark, sf):
    return tab(spark, sf, "conversations").join(tab(spark, sf, "labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_anti").select("conv_id", "turn")


@query("""SELECT conv_id, turn, list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank' END, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]') THEN 'control character' END], lambda x: x IS NOT NULL) AS problems FROM conversations""")
def pr08_target_text(spark, sf):
    return tab(spark, sf, "conversations").select("conv_id", "turn", constraints.target_problems(F.col("text")).alias("problems"))


ROUTES = Fixture("k bigint, level string, lanes array<string>, reasons array<string>, want array<string>", [
    (1, "R1", ["a"], [], []), (2, "R1", ["a", "b"], [], ["R1 lanes"]), (3, "R3", ["a"], ["x"], ["R3 lanes"]), (4, "R2", ["a"], ["x"], []), (5, "R3", ["a", "a"], [], ["lanes repeat", "reasons"]),
    (6, "R2", ["a", "b", "c", "d"], ["x"], ["lane count"]),
])


@case(f"SELECT k, want AS problems FROM {ROUTES.sql}")
def pr09_routes(spark, sf):
    return ROUTES.df(spark).select("k", constraints.route_problems(F.col("level"), F.col("lanes"), F.col("reasons")).alias("problems"))


DECISIONS = Fixture("k bigint, conf string, a string, b string, n bigint, strong bigint, contra boolean, conv string, fit string, best bigint, why string, form string, term string, want array<string>", [
    (1, "VERIFIED", "x", "y", 2, 1, False, "ESTABLISHED", "CONFIRMED", 3, "", "f", "t", []), (2, "VERIFIED", "x", "x", 1, 1, False, "RARE", "CONFIRMED", 1, "", "f", "t", ["same actor", "verified evidence", "verified form"]),
    (3, "SUPPORTED", "x", "y", 1, 0, False, "ATTESTED", "CONFIRMED", 2, "", "f", "t", ["supported evidence"]), (4, "SUPPORTED", "x", "y", 2, 1, False, "RARE", "CONFIRMED", 3, " ", "f", "t", ["mainstream"]),
    (5, "SUPPORTED", "x", "y", 2, 1, False, "RARE", "CONFIRMED", 3, "accuracy", "f", "t", []), (6, "PROVISIONAL", "x", "y", 0, 0, False, "UNATTESTED", "UNRESOLVED", 0, "", "f", "t", ["fit", "no attestation"]),
    (7, "RETAINED_UNRESOLVED", "x", "y", 0, 0, False, "UNATTESTED", "UNRESOLVED", 3, "", "f", "t", ["not retained"]),
])


@case(f"SELECT k, want AS problems FROM {DECISIONS.sql}")
def pr11_decisions(spark, sf):
    c = F.col
    p = constraints.decision_problems(c("conf"), c("a"), c("b"), c("n"), c("strong"), c("contra"), c("conv"), c("fit"), c("best"), c("why"), c("form"), c("term"))
    return DECISIONS.df(spark).select("k", p.alias("problems"))


TREATMENTS = Fixture("k bigint, tr string, conf string, want array<string>", [
    (1, "TRANSLATE_ONLY", "VERIFIED", []), (2, "TRANSLATE_ONLY", "SUPPORTED", ["needs source"]), (3, "RETAIN_SOURCE", "RETAINED_UNRESOLVED", []), (4, "TRANSLATE_WITH_SOURCE_FIRST", "RETAINED_UNRESOLVED", ["retention"]), (5, "RETAIN_SOURCE", "SUPPORTED", ["retention"]),
])


@case(f"SELECT k, want AS problems FROM {TREATMENTS.sql}")
def pr12_treatments(spark, sf):
    return TREATMENTS.df(spark).select("k", constraints.treatment_problems(F.col("tr"), F.col("conf")).alias("problems"))


SPANS = Fixture("k bigint, t string, s bigint, e bigint, q string, want array<string>", [
    (1, "héllo wörld", 0, 5, "héllo", []), (2, "héllo", 3, 9, "x", ["bounds"]), (3, "ab cd", 2, 3, " ", ["blank"]), (4, "abc", 0, 2, "xx", ["slice"]), (5, "abc", 2, 2, "", ["bounds"]), (6, "a\U0001f600b", 1, 2, "\U0001f600", []),
])


@case(f"SELECT k, want AS problems FROM {SPANS.sql}")
def pr19_spans(spark, sf):
    c = F.col
    return SPANS.df(spark).select("k", constraints.span_problems(c("t"), c("s").cast("int"), c("e").cast("int"), c("q")).alias("problems"))


INTERVALS = Fixture("k bigint, s bigint, e bigint", [(1, 0, 5), (1, 5, 9), (1, 8, 12), (2, 0, 10), (2, 2, 3), (2, 9, 11), (3, 1, 2), (3, 4, 6)])


@case(f"SELECT k, s, e FROM (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM {INTERVALS.sql}) WHERE u > s")
def pr14_wn05_overlaps(spark, sf):
    return constraints.overlapping(INTERVALS.df(spark), "k")


FINDINGS = "f array<string>, r array<string>"
ADJUDICATIONS = Fixture(f"k bigint, mode string, sel string, {FINDINGS}, want array<string>", [
    (1, "SELECT", "o1", ["f1|o1|MINOR"], [], []), (2, "SELECT", "o1", ["f1|o2|MAJOR"], ["f1|AVOIDED"], []), (3, "SELECT", "o1", ["f1|o1|MAJOR"], ["f1|CORRECTED"], ["own text"]),
    (4, "SELECT", "o1", ["f1|o1|CRITICAL"], ["f1|PRESERVED_SOURCE_AMBIGUITY"], ["critical stays"]), (5, "SELECT", "o1", ["f1|o2|BLOCKING"], [], ["unresolved"]), (6, "SYNTHESIZE", "o1", [], [], ["synthesis selects"]),
    (7, "SYNTHESIZE", None, ["f1|o2|MAJOR"], ["f1|AVOIDED"], ["synthesis avoids"]), (8, "SELECT", None, [], ["f9|AVOIDED"], ["no selection", "unknown finding"]), (9, "SELECT", "o1", ["f1|o2|MAJOR"], ["f1|CORRECTED"], ["other option"]),
])


@case(f"SELECT k, want AS problems FROM {ADJUDICATIONS.sql}")
def pr15_pr16_adjudication(spark, sf):
    part = lambda names: (lambda x: F.struct(*(F.split(x, r"\|")[i].alias(n) for i, n in enumerate(names))))
    f = F.transform("f", part(["finding_id", "option_key", "severity"]))
    r = F.transform("r", part(["finding_id", "action"]))
    return ADJUDICATIONS.df(spark).select("k", constraints.adjudication_problems(F.col("mode"), F.col("sel"), f, r).alias("problems"))


VERDICTS = Fixture("k bigint, v string, serious boolean, impact string, changed boolean, want array<string>", [
    (1, "PASS", False, "EQUIVALENT", False, []), (2, "PASS", True, "EQUIVALENT", False, ["verdict"]), (3, "BLOCK", False, "DEGRADES", True, []), (4, "BLOCK", False, "IMPROVES", False, ["unchanged", "verdict"]), (5, "PASS", False, "IMPROVES", True, []),
])


@case(f"SELECT k, want AS problems FROM {VERDICTS.sql}")
def pr17_pr18_verdicts(spark, sf):
    c = F.col
    return VERDICTS.df(spark).select("k", constraints.verdict_problems(c("v"), c("serious"), c("impact"), c("changed")).alias("problems"))


@query("WITH a AS (SELECT lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), b AS (SELECT lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def pr20_unequal_rows(spark, sf):
    d, l = docs(spark, sf), tab(spark, sf, "labels")
    return constraints.unequal(d.join(l, "doc_id", "left_semi").select("lang", "source"), d.join(l, "doc_id", "left_anti").select("lang", "source"))


@query("SELECT c.conv_id AS k FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE c.turn = 0 AND d.text IS DISTINCT FROM c.text")
def pr21_pr24_conflicts(spark, sf):
    stored = docs(spark, sf).select(F.col("doc_id").alias("k"), "text")
    return constraints.conflicts(stored, tab(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("k"), "text"), "k", "text")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.' || list_sort(json_keys(props))[1]) AS VARCHAR) AS first_value, json_valid(props) AS ok FROM events")
def pr22_json_shape(spark, sf):
    e = tab(spark, sf, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.select("event_id", F.element_at("m", F.element_at(F.array_sort(F.map_keys("m")), 1)).alias("first_value"), F.col("m").isNotNull().alias("ok"))


# --- terms -------------------------------------------------------------------------------------

TERMS = ["then", "the", "and", "thing", "of the", "in"]
_HITS = " UNION ALL ".join(
    f"SELECT doc_id, para, {i} AS rank, '{t}' AS term, p.s AS s, p.s + {len(t)} AS e FROM en, LATERAL (SELECT unnest(list_filter(range(0, length(source_text)), lambda x: substr(source_text, x + 1, {len(t)}) = '{t}')) AS s) p"
    for i, t in enumerate(sorted(TERMS, key=lambda t: (-len(t), t)))
)


def _occ(spark, sf):
    return terms.occurrences(units(spark, sf).select("doc_id", "para", "source_text"), TERMS).drop("source_text")


#: Hits in the order of their terms, folded one by one: a hit counts unless it overlaps an earlier one.
_KEPT = f"""hits AS ({_HITS}),
w AS (SELECT doc_id, para, list([rank, s, e] ORDER BY rank, s) AS hs FROM hits GROUP BY doc_id, para),
f AS (SELECT doc_id, para, hs, 1 AS i, []::BIGINT[][] AS acc FROM w UNION ALL
  SELECT doc_id, para, hs, i + 1, CASE WHEN len(list_filter(acc, lambda o: hs[i][2] < o[3] AND o[2] < hs[i][3])) > 0 THEN acc ELSE list_append(acc, hs[i]) END FROM f WHERE i <= len(hs)),
k AS (SELECT doc_id, para, unnest(acc) AS h FROM f WHERE i = len(hs) + 1)"""


@query(f"""WITH RECURSIVE {LINES}, en AS (SELECT * FROM rec WHERE disposition = 'translatable'), {_KEPT}
SELECT doc_id, para::INT AS para, ['of the', 'thing', 'then', 'and', 'the', 'in'][h[1] + 1] AS term, h[2]::INT AS s, h[3]::INT AS e FROM k""")
def jn05_sp01_sp02_occurrences(spark, sf):
    return _occ(spark, sf)


@query(f"""WITH RECURSIVE {LINES}, en AS (SELECT * FROM rec WHERE disposition = 'translatable'), {_KEPT}, o AS (SELECT doc_id, para::INT AS para, ['of the', 'thing', 'then', 'and', 'the', 'in'][h[1] + 1] AS term, h[2]::INT AS s, h[3]::INT AS e FROM k)
SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id, para, s, e) = 1 AS first_use FROM o""")
def wn04_first_use(spark, sf):
    return terms.with_first_use(_occ(spark, sf))


CONCEPTS = Fixture("source_term string, sense_id string, forms array<string>, seq bigint", [
    ("heat", "s1", ["热"], 1), ("heat", "s1", ["热量"], 2), ("cell", "s1", ["细胞"], 3), ("cell", "s2", ["电池"], 4), ("only", "s1", ["only"], 5), ("[[PT2-x]] a", "s1", ["b"], 6), ("work", "s1", ["work", "功"], 7),
])


@case("SELECT * FROM (VALUES ('heat', 's1', ['热量']), ('work', 's1', ['功'])) t(source_term, sense_id, forms)")
def ag09_clear_concepts(spark, sf):
    return terms.clear_concepts(CONCEPTS.df(spark))


# Evidence from the data: a page speaks for a term in its language with its host as authority.
_EV = """ev AS (SELECT substr(regexp_extract(url, '://[^/]*/([^/?#]*)', 1), 1, 2) AS term, regexp_extract(url, '://[^/]*\\.([a-z]+)[/?#]?', 1) AS form, 'web:' || regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS authority,
  CASE page_id % 5 WHEN 0 THEN 'A_AUTHORITY' WHEN 1 THEN 'B_DOMAIN' WHEN 2 THEN 'C_CORPUS' WHEN 3 THEN 'D_REFERENCE' ELSE 'E_WEAK' END AS tier,
  CASE WHEN page_id % 11 = 0 THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS stance, page_id % 3 > 0 AS sense_match, page_id % 7 > 0 AS domain_match, page_id % 4 AS conv FROM pages)"""


def _evidence(spark, sf):
    p = tab(spark, sf, "pages")
    tier = F.element_at(F.array(*(F.lit(t) for t in vl.TIER_WEIGHT)), (F.col("page_id") % 5 + 1).cast("int"))
    return p.select(
        F.substring(F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1), 1, 2).alias("term"), F.regexp_extract("url", r"://[^/]*\.([a-z]+)[/?#]?", 1).alias("form"), vl.authority(F.col("url"), F.lit("")).alias("authority"),
        tier.alias("tier"), F.when(F.col("page_id") % 11 == 0, "CONTRADICTS").otherwise("SUPPORTS").alias("stance"), (F.col("page_id") % 3 > 0).alias("sense_match"), (F.col("page_id") % 7 > 0).alias("domain_match"), F.get(F.array(*(F.lit(c) for c in vl.CONVENTIONALITY)), (F.col("page_id") % 4).cast("int")).alias("conventionality"),
    )


_CONF = f"""{_EV}, g AS (SELECT term, form, count(DISTINCT CASE WHEN sense_match AND domain_match AND stance = 'SUPPORTS' THEN authority END) AS sources,
  coalesce(bool_or(sense_match AND domain_match AND stance = 'SUPPORTS' AND tier IN ('A_AUTHORITY', 'B_DOMAIN')), false) AS strong,
  coalesce(bool_or(sense_match AND domain_match AND stance = 'CONTRADICTS' AND tier = 'A_AUTHORITY'), false) AS contradicted,
  sum(CASE WHEN sense_match AND domain_match AND stance = 'SUPPORTS' THEN CASE tier WHEN 'A_AUTHORITY' THEN 5 WHEN 'B_DOMAIN' THEN 4 WHEN 'C_CORPUS' THEN 2 WHEN 'D_REFERENCE' THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS evidence_rank, max(conv) AS best
  FROM ev GROUP BY term, form), c AS (SELECT * EXCLUDE (best), CASE WHEN sources = 0 THEN 'UNATTESTED' ELSE ['UNATTESTED', 'RARE', 'ATTESTED', 'ESTABLISHED'][1 + CASE WHEN sources = 1 THEN least(best, 2) ELSE best END] END AS conventionality FROM g),
conf AS (SELECT *, CASE WHEN sources >= 2 AND strong AND NOT contradicted AND conventionality IN ('ESTABLISHED', 'ATTESTED') THEN 'VERIFIED' WHEN sources > 0 AND (strong OR sources >= 2) AND NOT contradicted THEN 'SUPPORTED' WHEN sources > 0 THEN 'PROVISIONAL' ELSE 'RETAINED_UNRESOLVED' END AS confidence FROM c)"""


@query(f"WITH {_CONF} SELECT term, form, sources, strong, contradicted, evidence_rank, conventionality, confidence FROM conf")
def ag01_ag02_ag03_confidence(spark, sf):
    return terms.confidence(_evidence(spark, sf))


@query(f"""WITH {_CONF}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY CASE conventionality WHEN 'UNATTESTED' THEN 0 WHEN 'RARE' THEN 1 WHEN 'ATTESTED' THEN 2 ELSE 3 END DESC, evidence_rank DESC, form DESC) AS i FROM conf)
SELECT term, form FROM r WHERE i = 1""")
def so02_select_form(spark, sf):
    c = terms.confidence(_evidence(spark, sf)).withColumns({"fit": F.lit("CONFIRMED"), "selected": F.lit(False), "override": F.lit("")})
    return terms.select_form(c)


CHOICES = Fixture("term string, form string, fit string, conventionality string, evidence_rank bigint, selected boolean, override string", [
    ("a", "main", "CONFIRMED", "ESTABLISHED", 5, False, ""), ("a", "rare", "CONFIRMED", "RARE", 9, True, ""), ("b", "main", "CONFIRMED", "ESTABLISHED", 5, False, "why"), ("b", "rare", "CONFIRMED", "RARE", 1, True, "why"),
    ("c", "x", "REJECTED", "ESTABLISHED", 5, True, ""), ("d", "x", "CONFIRMED", "ATTESTED", 2, False, ""), ("d", "y", "CONFIRMED", "ATTESTED", 4, False, ""),
])


@case("SELECT * FROM (VALUES ('a', 'main'), ('b', 'rare'), ('c', 'c'), ('d', 'y')) t(term, form)")
def so02_select_cases(spark, sf):
    return terms.select_form(CHOICES.df(spark))


USES = Fixture("k bigint, conf string, first_use boolean, form string, src string", [
    (1, "VERIFIED", True, "熵", "entropy"), (2, "SUPPORTED", True, "熵", "entropy"), (3, "SUPPORTED", False, "熵", "entropy"), (4, "RETAINED_UNRESOLVED", True, "熵", "entropy"), (5, "PROVISIONAL", True, "焓", "enthalpy"),
])


@case(f"""SELECT k, CASE WHEN conf = 'VERIFIED' THEN 'TRANSLATE_ONLY' WHEN conf = 'RETAINED_UNRESOLVED' THEN 'RETAIN_SOURCE' ELSE 'TRANSLATE_WITH_SOURCE_FIRST' END AS treatment,
  CASE WHEN conf = 'RETAINED_UNRESOLVED' THEN src WHEN conf <> 'VERIFIED' AND first_use THEN form || '（' || src || '）' ELSE form END AS rendering FROM {USES.sql}""")
def sp03_so04_renderings(spark, sf):
    t = terms.treatment(F.col("conf"))
    return USES.df(spark).select("k", t.alias("treatment"), terms.rendering(t, F.col("first_use"), F.col("form"), F.col("src")).alias("rendering"))


@query("SELECT l.doc_id, l.quality, c.uri, c.tier FROM labels l JOIN (SELECT quality, source_key, arg_max(uri, seq) AS uri, arg_max(tier, seq) AS tier FROM (SELECT quality, toxic AS source_key, 'u' || doc_id AS uri, 't' || (doc_id % 5) AS tier, doc_id AS seq FROM labels) GROUP BY ALL) c ON c.quality = l.quality AND c.source_key = l.toxic")
def jn11_assessments(spark, sf):
    l = tab(spark, sf, "labels")
    m = l.select(F.col("quality").alias("form"), F.col("toxic").alias("source_key"), F.concat(F.lit("u"), "doc_id").alias("uri"), F.concat(F.lit("t"), F.col("doc_id") % 5).alias("tier"), F.col("doc_id").alias("seq"))
    a = l.select("doc_id", F.col("quality").alias("form"), F.col("toxic").alias("source_key"))
    return terms.last_assessments(a, m).select("doc_id", F.col("form").alias("quality"), "uri", "tier")


@query(r"""WITH c AS (SELECT DISTINCT lang AS source_term, ['com', 'org', 'net'][1 + doc_id % 3] AS sense_id FROM documents)
SELECT source_term, sense_id, page_id, url FROM c JOIN (SELECT page_id, url, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS t, regexp_extract(url, '://[^/]*\.([a-z]+)([/?#]|$)', 1) AS z FROM pages) ON t = source_term AND z = sense_id""")
def jn04_evidence_lookup(spark, sf):
    """Pages as evidence for the concepts that documents raise: language as term, a top-level label as sense."""
    e = tab(spark, sf, "pages").select(F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("source_term"), F.regexp_extract("url", r"://[^/]*\.([a-z]+)([/?#]|$)", 1).alias("sense_id"), "page_id", "url")
    sense = F.get(F.array(F.lit("com"), F.lit("org"), F.lit("net")), (F.col("doc_id") % 3).cast("int"))
    return terms.evidence_for(docs(spark, sf).select(F.col("lang").alias("source_term"), sense.alias("sense_id")), e)


# --- routing -----------------------------------------------------------------------------------

_RISK = f"""{LINES}, u AS (SELECT doc_id * 100000 + para AS unit, regexp_matches(source_text, '(^|[^A-Za-z])\\d') AS num FROM rec WHERE disposition = 'translatable'),
m AS (SELECT doc_id * 100000 AS unit, CASE WHEN toxic = 1 THEN 'R3' WHEN quality = 0 THEN 'R2' ELSE 'R9' END AS level FROM labels),
t AS (SELECT conv_id * 100000 + turn AS unit, bool_or(role = 'user') AS open FROM conversations GROUP BY 1),
j AS (SELECT u.unit, num, coalesce(CASE m.level WHEN 'R3' THEN 3 WHEN 'R2' THEN 2 END, 1) AS ml, CASE WHEN m.level IN ('R2', 'R3') THEN 1 ELSE 0 END AS has_m, t.open FROM u LEFT JOIN m ON u.unit = m.unit LEFT JOIN t ON u.unit = t.unit),
k AS (SELECT *, greatest(ml, CASE WHEN num THEN 2 ELSE 1 END) AS raised FROM j),
l AS (SELECT *, CASE WHEN coalesce(open, false) THEN 3 WHEN open IS NOT NULL AND raised < 2 THEN 2 ELSE raised END AS risk FROM k)"""


@query(f"""WITH {_RISK}, z AS (SELECT unit, 'R' || risk AS risk_level, risk, list_sort(list_distinct(list_filter([CASE WHEN has_m = 1 THEN 'label' END, CASE WHEN num AND 2 >= raised THEN 'protected numeric meaning' END,
  CASE WHEN open IS NOT NULL AND raised < 2 THEN 'evidence-governed terminology' END, CASE WHEN open THEN 'unresolved or provisional terminology' END], lambda x: x IS NOT NULL))) AS reasons FROM l)
SELECT unit, risk_level, CASE WHEN risk = 1 THEN ['baseline'] ELSE ['baseline', 'alternative'] END AS lanes, CASE WHEN risk > 1 AND len(reasons) = 0 THEN ['model-identified semantic risk'] ELSE reasons END AS reasons FROM z""")
def jn07_jn13_pl13_routing(spark, sf):
    floor_reasons = F.when(F.col("source_text").rlike(r"(?<![A-Za-z])\d"), F.array(F.lit("protected numeric meaning"))).otherwise(F.array().cast("array<string>"))
    u = units(spark, sf).select((F.col("doc_id") * 100000 + F.col("para")).alias("unit"), floor_reasons.alias("floor_reasons"), F.lit(False).alias("has_formula"))
    u = u.withColumn("floor", F.when(F.size("floor_reasons") > 0, "R2").otherwise("R1"))
    level = F.when(F.col("toxic") == 1, "R3").when(F.col("quality") == 0, "R2").otherwise("R9")
    r = tab(spark, sf, "labels").select((F.col("doc_id") * 100000).alias("unit"), level.alias("level"), F.array(F.lit("label")).alias("reasons"), F.lit(1).alias("seq"))
    g = tab(spark, sf, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("unit"), F.when(F.col("role") == "user", "PROVISIONAL").otherwise("VERIFIED").alias("confidence"))
    return terms.route(u, r, g)


# --- context and chunks ------------------------------------------------------------------------


#: Neighbours of every record, nearest first, kept while they fit into ``BUDGET`` characters.
_NEAR = """nb AS (SELECT a.doc_id, a.para, list([abs(b.para - a.para), CASE WHEN b.para > a.para THEN 1 ELSE 0 END, b.para, length(b.source_text)] ORDER BY abs(b.para - a.para), b.para) AS ns
  FROM rec a JOIN rec b ON a.doc_id = b.doc_id AND b.para BETWEEN a.para - 4 AND a.para + 4 AND a.para <> b.para GROUP BY a.doc_id, a.para),
f AS (SELECT doc_id, para, ns, 1 AS i, 0::BIGINT AS used, []::BIGINT[] AS kept FROM nb UNION ALL
  SELECT doc_id, para, ns, i + 1, CASE WHEN used + ns[i][4] > BUDGET THEN used ELSE used + ns[i][4] END, CASE WHEN used + ns[i][4] > BUDGET THEN kept ELSE list_append(kept, ns[i][3]) END FROM f WHERE i <= len(ns)),
g AS (SELECT doc_id, para, list_sort(kept) AS kept FROM f WHERE i = len(ns) + 1)"""
_SIDES = "coalesce(list_filter(kept, lambda x: x < rec.para), []) AS before, coalesce(list_filter(kept, lambda x: x > rec.para), []) AS after FROM rec LEFT JOIN g ON rec.doc_id = g.doc_id AND rec.para = g.para"


@query(f"""WITH RECURSIVE {LINES}, {_NEAR.replace("BUDGET", "6000")} SELECT rec.doc_id, rec.para::INT AS para, {_KEY.replace("doc_id", "rec.doc_id").replace("|| para", "|| rec.para")} AS record_key, {_REV.replace("|| doc_id", "|| rec.doc_id").replace("|| para", "|| rec.para")} AS record_revision,
  CASE WHEN regexp_matches(source_text, '(^|[^A-Za-z])\\d') OR (lang = 'en' AND regexp_matches(lower(source_text),
  '(^|\\W)(not|no|never|neither|unless|except|only|must|shall|should|may|might|can|cannot|could|would|at\\s+least|at\\s+most|more\\s+than|less\\s+than|respectively)($|\\W)')) THEN 'R2' ELSE 'R1' END AS risk, {_SIDES} WHERE disposition = 'translatable'""")
def flagship_context(spark, sf):
    """Paragraph records with identity, risk floor and context window."""
    r = records.identify(records.segment(docs(spark, sf)))
    w = context.context_windows(r, only=F.col("disposition") == "translatable")
    return w.select("doc_id", "para", "record_key", "record_revision", tx.risk_floor(F.col("source_text"), F.col("lang")).alias("risk"), "before", "after")


@query(f"WITH RECURSIVE {LINES}, {_NEAR.replace('BUDGET', '300')} SELECT rec.doc_id, rec.para::INT AS para, {_SIDES}")
def wn01_context_windows(spark, sf):
    return context.context_windows(records.segment(docs(spark, sf)), budget=300).select("doc_id", "para", "before", "after")


@query(f"""WITH RECURSIVE {LINES}, w AS (SELECT doc_id, list(length(source_text) ORDER BY para) AS ns FROM rec GROUP BY doc_id),
f AS (SELECT doc_id, ns, 1 AS i, 0::BIGINT AS used, 0 AS chunk, []::INT[] AS acc FROM w UNION ALL
  SELECT doc_id, ns, i + 1, CASE WHEN used > 0 AND used + ns[i] > 2000 THEN ns[i] ELSE used + ns[i] END, CASE WHEN used > 0 AND used + ns[i] > 2000 THEN chunk + 1 ELSE chunk END,
  list_append(acc, CASE WHEN used > 0 AND used + ns[i] > 2000 THEN chunk + 1 ELSE chunk END) FROM f WHERE i <= len(ns)),
o AS (SELECT doc_id, acc FROM f WHERE i = len(ns) + 1)
SELECT doc_id, unnest(range(0, len(acc)))::INT AS para, unnest(acc) AS chunk FROM o""")
def wn02_chunks(spark, sf):
    r = records.segment(docs(spark, sf)).withColumn("n", F.length("source_text"))
    return context.chunks(r, limit=2000)


@query(f"WITH {LINES} SELECT doc_id, para::INT AS para, length(source_text) AS n FROM rec WHERE length(source_text) > 400")
def wn03_oversize(spark, sf):
    r = records.segment(docs(spark, sf)).select("doc_id", "para", F.length("source_text").cast("long").alias("n"))
    return context.oversize(r, "n", 400)


# --- ledgers -----------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS ordinal, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS supersedes,
  turn = max(turn) OVER (PARTITION BY conv_id) AS active FROM conversations""")
def wn07_wn08_history(spark, sf):
    c = tab(spark, sf, "conversations").withColumn("h", F.sha2("text", 256))
    return ledger.history(c, "conv_id", "turn", "h").select("conv_id", "turn", "ordinal", "supersedes", "active")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, sha256(arg_max(text, turn)) AS h FROM conversations GROUP BY conv_id")
def so01_latest(spark, sf):
    return ledger.latest(tab(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", F.sha2("text", 256).alias("h"))


@query("""WITH a AS (SELECT conv_id AS unit_key, max(turn) AS t FROM conversations GROUP BY conv_id)
SELECT a.unit_key, c.role, d.lang, l.quality FROM a JOIN conversations c ON c.conv_id = a.unit_key AND c.turn = a.t JOIN labels l ON l.doc_id = a.unit_key JOIN documents d ON d.doc_id = l.doc_id""")
def jn01_jn02_jn03_jn14_resolve(spark, sf):
    c = tab(spark, sf, "conversations").withColumn("approval_id", F.struct("conv_id", "turn"))
    active = c.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.struct("conv_id", "turn").alias("approval_id"))
    u = tab(spark, sf, "labels").select(F.col("doc_id").alias("unit_key"), F.col("doc_id").alias("record_key"), "quality")
    r = docs(spark, sf).select(F.col("doc_id").alias("record_key"), "lang")
    return ledger.resolve_active(active, c.withColumnRenamed("conv_id", "unit_key"), u, r).select("unit_key", "role", "lang", "quality")


@query("""WITH st AS (SELECT conv_id, text FROM conversations WHERE turn = 1), inc AS (SELECT conv_id, text FROM conversations WHERE turn IN (0, 2) UNION ALL SELECT conv_id, text FROM st WHERE conv_id % 2 = 0)
SELECT inc.conv_id, CASE WHEN count(DISTINCT coalesce(inc.text, chr(1))) > 1 OR bool_or(st.conv_id IS NOT NULL AND inc.text IS DISTINCT FROM st.text) THEN 'conflict' WHEN bool_or(st.conv_id IS NOT NULL) THEN 'replay' ELSE 'new' END AS state
FROM inc LEFT JOIN st ON st.conv_id = inc.conv_id GROUP BY inc.conv_id""")
def src12_st11_insert_once(spark, sf):
    """Second turns are stored; first and third turns and half of the stored ones come in for the same slots."""
    c = tab(spark, sf, "conversations").select("conv_id", "turn", "text")
    stored = c.where("turn = 1")
    incoming = c.where("turn IN (0, 2)").unionByName(stored.where("conv_id % 2 = 0"))
    return ledger.write_once(stored, incoming, "conv_id", "text")


# Events as attempts: a user's events of a day, in time order, are the attempts of one call.
def _attempts(spark, sf):
    e = tab(spark, sf, "events")
    out = F.when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "error", "PERMANENT_FAILURE").otherwise("RETRYABLE_FAILURE")
    e = e.withColumn("call", F.concat_ws("@", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    w = Window.partitionBy("call").orderBy("ts", "event_id")
    return e.select("call", F.row_number().over(w).alias("ordinal"), out.alias("outcome"), "ts", "event_id", "value")


_ATT = "att AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS call, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id)::INT AS ordinal, CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'PERMANENT_FAILURE' ELSE 'RETRYABLE_FAILURE' END AS outcome, ts, event_id, value FROM events)"


@query(f"""WITH {_ATT} SELECT call, count(*) AS n_attempts, CASE WHEN bool_or(outcome = 'SUCCEEDED') THEN 'SUCCEEDED' WHEN arg_max(outcome, ordinal) = 'PERMANENT_FAILURE' THEN 'FAILED_PERMANENT' WHEN count(*) >= 3 THEN 'EXHAUSTED' ELSE 'PENDING' END AS status
FROM att GROUP BY call""")
def st02_st06_st08_call_status(spark, sf):
    return ledger.call_status(_attempts(spark, sf))


@query(f"WITH {_ATT} SELECT DISTINCT call FROM att WHERE call NOT IN (SELECT call FROM att WHERE outcome = 'SUCCEEDED') AND call NOT IN (SELECT call FROM (SELECT call, count(*) AS n, arg_max(outcome, ordinal) AS o FROM att GROUP BY call) WHERE n >= 3 OR o = 'PERMANENT_FAILURE')")
def st02_pending_calls(spark, sf):
    a = _attempts(spark, sf)
    return ledger.pending_calls(a.select("call").distinct(), ledger.call_status(a))


@query(f"WITH {_ATT} SELECT a.call, b.event_id FROM (SELECT DISTINCT call FROM att) a JOIN att b ON a.call = b.call AND b.outcome = 'SUCCEEDED'")
def st09_cached_results(spark, sf):
    a = _attempts(spark, sf)
    return ledger.cached_results(a.select("call").distinct(), a.where("outcome = 'SUCCEEDED'").select("call", "event_id"))


@query(f"""WITH RECURSIVE {_ATT}, w AS (SELECT call, list(value ORDER BY ts, event_id) AS vs, list(event_id ORDER BY ts, event_id) AS es FROM att GROUP BY call),
f AS (SELECT call, vs, es, 1 AS i, 0.0::DOUBLE AS spent, []::BOOLEAN[] AS adm, []::DOUBLE[] AS sp FROM w UNION ALL
  SELECT call, vs, es, i + 1, CASE WHEN spent + vs[i] <= 60 THEN spent + vs[i] ELSE spent END, list_append(adm, spent + vs[i] <= 60), list_append(sp, CASE WHEN spent + vs[i] <= 60 THEN spent + vs[i] ELSE spent END) FROM f WHERE i <= len(vs)),
o AS (SELECT call, es, adm, sp FROM f WHERE i = len(vs) + 1)
SELECT call, unnest(es) AS event_id, unnest(adm) AS admitted, round(unnest(sp), 6) AS spent FROM o""")
def wn06_ag06_budget(spark, sf):
    b = ledger.admit_by_budget(_attempts(spark, sf), "call", ["ts", "event_id"], "value", 60.0)
    return b.select("call", "event_id", "admitted", F.round("spent", 6).alias("spent"))


@query(f"WITH {_ATT} SELECT call, count(*) AS attempted_calls, round(sum(value), 4) AS estimated_cost FROM att GROUP BY call")
def ag06_usage(spark, sf):
    return ledger.usage(_attempts(spark, sf), "call", "value").withColumn("estimated_cost", F.round("estimated_cost", 4))


@query("""WITH RECURSIVE w AS (SELECT user_id, list(ts ORDER BY ts, event_id) AS tt, list(event_id ORDER BY ts, event_id) AS es FROM events GROUP BY user_id),
f AS (SELECT user_id, tt, es, 1 AS i, NULL::TIMESTAMP AS until, []::BOOLEAN[] AS g, []::BOOLEAN[] AS o FROM w UNION ALL
  SELECT user_id, tt, es, i + 1, CASE WHEN until IS NULL OR tt[i] >= until THEN tt[i] + INTERVAL 86400 SECOND ELSE until END, list_append(g, until IS NULL OR tt[i] >= until), list_append(o, until IS NOT NULL AND tt[i] >= until) FROM f WHERE i <= len(tt)),
r AS (SELECT user_id, es, g, o FROM f WHERE i = len(tt) + 1)
SELECT user_id, unnest(es) AS event_id, unnest(g) AS granted, unnest(o) AS takeover FROM r""")
def st03_leases(spark, sf):
    """A user's events as acquisitions of a lease of a day."""
    return ledger.leases(tab(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], 86_400).drop("ts")


LEASES = Fixture("call string, token string, acquired_at timestamp_ntz, expires_at timestamp_ntz", [
    ("c", "t1", "2024-01-01 00:00:00", "2024-01-01 00:00:10"), ("c", "t2", "2024-01-01 00:00:11", "2024-01-01 00:00:21"), ("d", "t3", "2024-01-01 00:00:00", "2024-01-01 00:00:10"),
])
COMMITS = Fixture("call string, token string, done_at timestamp_ntz, want boolean", [
    ("c", "t1", "2024-01-01 00:00:05", True), ("c", "t1", "2024-01-01 00:00:12", False), ("c", "t2", "2024-01-01 00:00:12", True), ("d", "t3", "2024-01-01 00:00:10", False), ("e", "t9", "2024-01-01 00:00:01", False),
])


@case(f"SELECT call, token, done_at, want AS valid FROM {COMMITS.sql}")
def st04_st12_fencing(spark, sf):
    return ledger.fenced_commits(COMMITS.df(spark).drop("want"), LEASES.df(spark))


@case(f"SELECT k, CASE WHEN e IN ('rate_limit', 'transient', 'timeout', 'connection', 'os_error') THEN true ELSE false END AS retry, CASE WHEN code = 429 THEN 'rate_limit' WHEN code IN (408, 409) OR code >= 500 THEN 'transient' WHEN code >= 400 THEN 'permanent' ELSE 'ok' END AS class FROM (VALUES (1, 'timeout', 429), (2, 'value', 404), (3, 'os_error', 503), (4, 'rate_limit', 200), (5, 'x', 409)) t(k, e, code)")
def st05_src18_errors(spark, sf):
    f = Fixture("k int, e string, code int", [(1, "timeout", 429), (2, "value", 404), (3, "os_error", 503), (4, "rate_limit", 200), (5, "x", 409)]).df(spark)
    return f.select("k", ledger.classify_error(F.col("e")).alias("retry"), ledger.retryable_status(F.col("code")).alias("class"))


@query("""SELECT event_id, sha256('{"namespace":"ledgerloom.call/1","payload":{"dependency":"' || sha256(props) || '","stage":"' || event_type || '"}}') AS call_key FROM events""")
def st01_st13_st15_call_keys(spark, sf):
    return tab(spark, sf, "events").select("event_id", ids.call_key(F.col("event_type"), F.col("props")).alias("call_key"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 200 WHEN 'purchase' THEN 300 END AS tokens FROM events")
def st14_estimates(spark, sf):
    e = spark.createDataFrame([("view", 100), ("click", 200), ("purchase", 300)], "event_type string, tokens int")
    return tab(spark, sf, "events").join(F.broadcast(e), "event_type", "left").select("event_id", "tokens")


@query("SELECT count(*) AS n_units, count(*) FILTER (toxic = 1) AS n_blocked, count(*) FILTER (quality = 1) AS n_active, count(*) FILTER (quality = 0) AS n_pending FROM labels")
def ag04_status(spark, sf):
    return tab(spark, sf, "labels").agg(F.count("*").alias("n_units"), F.count_if(F.col("toxic") == 1).alias("n_blocked"), F.count_if(F.col("quality") == 1).alias("n_active"), F.count_if(F.col("quality") == 0).alias("n_pending"))


@query("SELECT 'documents' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations")
def ag05_stage_counts(spark, sf):
    parts = [tab(spark, sf, n).select(F.lit(n).alias("stage")) for n in ("documents", "labels", "pages", "conversations")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("stage").agg(F.count("*").alias("n"))


STATES = Fixture("k bigint, err boolean, art boolean, reports bigint, rel boolean, units bigint, want string", [
    (1, True, True, 1, True, 5, "BLOCKED"), (2, False, True, 1, True, 5, "RELEASED"), (3, False, False, 2, True, 5, "BLOCKED"), (4, False, False, 0, True, 5, "VERIFYING"), (5, False, False, 0, False, 5, "IN_PROGRESS"), (6, False, False, 0, False, 0, "NEW"),
])


@case(f"SELECT k, want AS state FROM {STATES.sql}")
def so01_project_state(spark, sf):
    c = F.col
    return STATES.df(spark).select("k", ledger.project_state(c("err"), c("art"), c("reports"), c("rel"), c("units")).alias("state"))


# --- review bus --------------------------------------------------------------------------------


def _findings(spark, sf):
    sev = F.when(F.col("toxic") == 1, "BLOCKING").when(F.col("quality") == 0, "MAJOR").otherwise("MINOR")
    return tab(spark, sf, "labels").select("doc_id", F.col("doc_id").alias("unit"), sev.alias("severity"), F.when(F.col("toxic") == 1, "REGISTER").otherwise("FLUENCY").alias("category"), F.lit("label").alias("message"))


_FIND = "find AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'BLOCKING' WHEN quality = 0 THEN 'MAJOR' ELSE 'MINOR' END AS severity FROM labels)"


@query(f"WITH {_RISK} SELECT unit, 0 AS lane_ordinal, 'baseline' AS lane FROM l UNION ALL SELECT unit, 1, 'alternative' FROM l WHERE risk > 1")
def jn12_pl02_lanes(spark, sf):
    return bus.lanes(jn07_jn13_pl13_routing(spark, sf))


@query("""SELECT sha256('{"namespace":"ledgerloom.option/1","payload":{"candidate":"' || sha256(text) || '","unit":"' || conv_id || '"}}') AS option_key, conv_id AS unit, text AS target_text FROM conversations""")
def pl03_pr23_options(spark, sf):
    c = tab(spark, sf, "conversations").select(F.col("conv_id").alias("unit"), F.sha2("text", 256).alias("candidate_id"), F.col("text").alias("target_text"))
    return bus.options(c)


@query("SELECT a.conv_id AS unit, a.text IS DISTINCT FROM b.text AS changed FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1")
def pl06_edits(spark, sf):
    c = tab(spark, sf, "conversations")
    a = c.where("turn = 0").select(F.col("conv_id").alias("unit"), F.col("text").alias("target_text"))
    b = c.where("turn = 1").select(F.col("conv_id").alias("unit"), F.col("text").alias("edited_text"))
    return bus.edits(a, b).select("unit", "changed")


#: What is no ASCII but part of a word counts as one that no Latin word holds, so all engines see the same borders.
_LATIN = r"regexp_replace({}, '[^\x00-\x7F\pP\pS\pZ\pC]', '_', 'g')"


def gate_sql(source: str, target: str) -> str:
    """Rows of a relation with text columns ``source`` and ``target``: whether the gate for untranslated text holds them."""
    s, t = _LATIN.format(source), _LATIN.format(target)
    line = lambda x: rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
    ws = rf"regexp_extract_all({s}, '(?i)\b[A-Z][A-Z''-]{{1,}}\b')"
    kept = rf"len(list_filter({ws}, lambda w: regexp_matches({t}, '(?i)\b' || w || '\b')))"
    cjk = f"len(regexp_extract_all({target}, '[㐀-鿿]'))"
    return f"(len({ws}) > 0 AND ({line(source)} = {line(target)} OR (len({ws}) >= 2 AND {kept} >= 0.8 * len({ws}) AND {cjk} < greatest(4, len({ws}) * 2)) OR (len({ws}) = 1 AND {kept} = 1 AND {cjk} = 0)))"


_VER = f"""{_FIND}, e AS (SELECT a.conv_id AS unit, CASE WHEN a.text = b.text THEN 'EQUIVALENT' WHEN length(b.text) * 4 < length(a.text) THEN 'DEGRADES' ELSE 'IMPROVES' END AS impact,
  {gate_sql("a.text", "CASE WHEN length(a.text) < length(b.text) THEN a.text ELSE b.text END")} AS untranslated FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
v AS (SELECT e.unit, impact, untranslated, coalesce(severity IN ('MAJOR', 'CRITICAL', 'BLOCKING'), false) AS serious, (CASE WHEN severity IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_findings, CASE WHEN coalesce(severity IN ('MAJOR', 'CRITICAL', 'BLOCKING'), false) OR impact = 'DEGRADES' OR untranslated THEN 'BLOCK' ELSE 'PASS' END AS verdict FROM e LEFT JOIN find ON find.doc_id = e.unit)"""


def _verified(spark, sf):
    """First turns as sources, the shorter of the first and second as their Chinese targets, which the gate holds where they only repeat the source."""
    c = tab(spark, sf, "conversations")
    pair = c.where("turn = 0").select("conv_id", F.col("text").alias("a")).join(c.where("turn = 1").select("conv_id", F.col("text").alias("b")), "conv_id")
    impact = F.when(F.col("a") == F.col("b"), "EQUIVALENT").when(F.length("b") * 4 < F.length("a"), "DEGRADES").otherwise("IMPROVES")
    none, target = F.array().cast("array<string>"), F.when(F.length("a") < F.length("b"), F.col("a")).otherwise(F.col("b"))
    e = pair.select(F.col("conv_id").alias("unit"), impact.alias("impact"), tx.untranslated(F.col("a"), target, F.lit("zh-Hans"), none, none, none).alias("untranslated"))
    return bus.verify(e, _findings(spark, sf))


@query(f"WITH {_VER} SELECT * FROM v")
def pl04_pl07_verification(spark, sf):
    return _verified(spark, sf)


@query(f"WITH {_VER} SELECT unit, n_findings FROM v WHERE verdict = 'PASS'")
def pl08_outcomes(spark, sf):
    return bus.outcomes(_verified(spark, sf)).select("unit", "n_findings")


_CH = f"{_FIND}, ch AS (SELECT doc_id // 10 AS doc_id, doc_id % 3 AS chunk, CASE WHEN bool_or(severity IN ('MAJOR', 'CRITICAL', 'BLOCKING')) THEN 'BLOCK' ELSE 'PASS' END AS verdict, count(*) AS n FROM find GROUP BY 1, 2)"


def _chunked(spark, sf):
    return bus.chunk_reports(_findings(spark, sf).select(F.expr("doc_id div 10").alias("doc_id"), (F.col("doc_id") % 3).alias("chunk"), "severity"))


@query(f"WITH {_CH} SELECT * FROM ch")
def ud04_chunk_reports(spark, sf):
    return _chunked(spark, sf)


@query(f"WITH {_CH} SELECT doc_id, CASE WHEN bool_or(verdict = 'BLOCK') THEN 'BLOCK' ELSE 'PASS' END AS verdict, count(*) AS n_chunks, NOT bool_or(verdict = 'BLOCK') AND count(*) > 1 AS needs_synthesis FROM ch GROUP BY doc_id")
def ag08_pl09_merge(spark, sf):
    return bus.merge_reports(_chunked(spark, sf))


@query("SELECT DISTINCT doc_id % 20 AS doc_id, 'label' AS message, CASE WHEN toxic = 1 THEN 'BLOCKING' WHEN quality = 0 THEN 'MAJOR' ELSE 'MINOR' END AS severity, CASE WHEN toxic = 1 THEN 'REGISTER' ELSE 'FLUENCY' END AS category, doc_id % 2 AS unit FROM labels")
def ag08_merged_findings(spark, sf):
    f = _findings(spark, sf).withColumns({"unit": F.col("doc_id") % 2, "doc_id": F.col("doc_id") % 20})
    return bus.merged_findings(f).select("doc_id", "message", "severity", "category", "unit")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n, sha256(string_agg({_KEY}, chr(10) ORDER BY para)) AS outcome_set_id FROM rec GROUP BY doc_id")
def ag10_se07_outcome_set(spark, sf):
    r = records.identify(records.segment(docs(spark, sf))).withColumnRenamed("record_key", "outcome_id")
    return bus.outcome_set(r)


def _whole_echo(pdf):
    return pdf.assign(reply=pdf.text)[["call", "reply"]]


@query("SELECT conv_id * 100 + turn AS call, text AS reply FROM conversations")
def ud01_ud02_ud03_whole_replies(spark, sf):
    """Turns as calls of a service that answers with the whole text, of which those of users have stored results."""
    services = bus.Registry()
    services.add("echo", "call long, reply string")(_whole_echo)
    q = tab(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("call"), "text", "role")
    stored = q.where("role = 'user'").select("call", F.col("text").alias("reply"))
    return bus.memoized(q, stored, lambda r: services.call("echo", r))


# --- gates -------------------------------------------------------------------------------------


@query(rf"""WITH u AS (SELECT item_id AS unit, item_id AS page, string_split(replace(text, ' the ', '[[PT2-0123456789ab:F:0001]]'), '[[PT2-0123456789ab:F:0001]]') AS parts FROM benchmark),
p AS (SELECT unit, page, unnest(range(0, len(parts))) AS place, trim(unnest(parts)) AS fragment FROM u),
k AS (SELECT *, regexp_replace(fragment, '\s+', '', 'g') AS bare FROM p), g AS (SELECT k.* FROM k LEFT JOIN documents d ON d.doc_id = page
  WHERE length(bare) >= 2 AND regexp_matches(fragment, '[\p{{L}}\p{{N}}]') AND (d.doc_id IS NULL OR strpos(regexp_replace(d.text, '\s+', '', 'g'), bare) = 0))
SELECT unit, count(*) AS n_missing, list_slice(list(left(fragment, 120) ORDER BY place), 1, 3) AS evidence FROM g GROUP BY unit""")
def jn08_so05_literals(spark, sf):
    """Benchmark texts, cut at their articles by protected tokens, against the document of the same number."""
    u = tab(spark, sf, "benchmark").select(F.col("item_id").alias("unit"), F.col("item_id").alias("page"), F.replace("text", F.lit(" the "), F.lit("[[PT2-0123456789ab:F:0001]]")).alias("text"))
    return gates.missing_literals(u, docs(spark, sf).select(F.col("doc_id").alias("page"), F.col("text").alias("page_text")))


PAGES_S = Fixture("page bigint, text string", [(1, "In 1999 E = mc2 at https://a.org/x."), (2, "nothing"), (3, "12 and 13 and 14")])
PAGES_T = Fixture("page bigint, text string", [(1, "1999 年 E=mc2"), (2, ""), (3, "12 13")])


@case("SELECT * FROM (VALUES (1::BIGINT, ['https://a.org/x'], 1::BIGINT), (3, ['14'], 1)) t(page, missing, n)")
def jn09_so06_anchors(spark, sf):
    return gates.missing_anchors(PAGES_S.df(spark), PAGES_T.df(spark))


@query(f"""WITH s AS (SELECT doc_id AS page, unnest({_anchors_sql("text")}) AS anchor FROM documents), t AS (SELECT doc_id - 1 AS page, regexp_replace(nfc_normalize(text), '[{_WS}]+', '', 'g') AS key FROM documents)
SELECT s.page, list_sort(list_distinct(list(anchor))) AS missing, count(*) AS n FROM s LEFT JOIN t ON s.page = t.page WHERE coalesce(strpos(key, regexp_replace(nfc_normalize(anchor), '[{_WS}]+', '', 'g')), 0) = 0 GROUP BY s.page""")
def jn09_so06_document_anchors(spark, sf):
    """Anchors of every document that the one with the next id lacks, all of them shown."""
    d = docs(spark, sf)
    return gates.missing_anchors(d.select(F.col("doc_id").alias("page"), "text"), d.select((F.col("doc_id") - 1).alias("page"), "text"), show=2**31 - 1)


@query("WITH s AS (SELECT doc_id % 7 AS page, source AS digest, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT doc_id % 7 AS page, source AS digest, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL) SELECT s.page, s.digest, s.n - coalesce(t.n, 0) AS missing FROM s LEFT JOIN t ON s.page = t.page AND s.digest = t.digest WHERE s.n > coalesce(t.n, 0)")
def se03_ag12_images(spark, sf):
    d = docs(spark, sf).select((F.col("doc_id") % 7).alias("page"), F.col("source").alias("digest"), "doc_id")
    return gates.missing_images(d, d.join(tab(spark, sf, "labels"), "doc_id", "left_semi"))


_BOX = "b AS (SELECT page_id % 5 AS page, page_id % 4 AS block, page_id AS line, (page_id * 37 % 500)::DOUBLE AS x0, (page_id * 53 % 700)::DOUBLE AS y0, (page_id * 37 % 500 + 20 + page_id % 90)::DOUBLE AS x1, (page_id * 53 % 700 + 10 + page_id % 40)::DOUBLE AS y1 FROM pages)"


def _lines(spark, sf):
    i = F.col("page_id")
    d = lambda c: c.cast("double")
    return tab(spark, sf, "pages").select((i % 5).alias("page"), (i % 4).alias("block"), i.alias("line"), d(i * 37 % 500).alias("x0"), d(i * 53 % 700).alias("y0"), d(i * 37 % 500 + 20 + i % 90).alias("x1"), d(i * 53 % 700 + 10 + i % 40).alias("y1"))


@query(f"""WITH {_BOX}, e AS (SELECT line % 2 AS page, block, line, x0, y0, x1 + 2 * (x1 - x0) AS x1, y1 + 2 * (y1 - y0) AS y1 FROM b), j AS (SELECT a.page, least(a.x1, c.x1) - greatest(a.x0, c.x0) AS w, least(a.y1, c.y1) - greatest(a.y0, c.y0) AS h, least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0)) AS m
FROM e a JOIN e c ON a.page = c.page AND a.line < c.line AND a.block <> c.block) SELECT page, count(*) AS overlaps FROM j WHERE w > 0 AND h > 0 AND w * h > 0.3 * m GROUP BY page""")
def jn10_overlaps(spark, sf):
    """Lines of every page, three times as wide and high, of which many overlap."""
    wide = _lines(spark, sf).withColumns({"page": F.col("line") % 2, "x1": F.col("x1") + 2 * (F.col("x1") - F.col("x0")), "y1": F.col("y1") + 2 * (F.col("y1") - F.col("y0"))})
    return gates.overlapping_lines(wide, threshold=0.3)


@query(f"WITH {_BOX} SELECT page, block::INT AS block, line::INT AS line, x0, y0, x1, y1 FROM (SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY block) - 1 AS block, row_number() OVER (PARTITION BY page, block ORDER BY line) - 1 AS line, x0, y0, x1 - 40 AS x1, y1 FROM b) WHERE x1 > x0")
def sp08_sp09_line_boxes(spark, sf):
    l = _lines(spark, sf)
    per = l.groupBy("page", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "x0", "y0", (F.col("x1") - 40).alias("x1"), "y1"))), lambda x: x.dropFields("line")).alias("ls"))
    nested = per.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "ls"))), lambda x: x["ls"]).alias("blocks"))
    return gates.line_boxes(nested)


_PAIR = "page bigint, sw double, sh double, tw double, th double, s_text string, t_text string, s_images bigint, t_images bigint, missing_images bigint, fonts bigint, notdef boolean, outside bigint, overlaps bigint, s_ink double, t_ink double, raster_ok boolean"
PAIRS = Fixture(_PAIR, [
    (1, 420.0, 300.0, 420.5, 300.0, "a", "b", 1, 1, 0, 1, False, 0, 0, 0.1, 0.1, True), (2, 420.0, 300.0, 500.0, 300.0, "a", " ", 0, 0, 1, 0, False, 0, 0, 0.1, 0.0, True),
    (3, 1.0, 1.0, 1.0, 1.0, "a", "b�", 0, 0, 0, 0, True, 2, 3, 0.1, 0.01, True), (4, 1.0, 1.0, 1.0, 1.0, "a", "b", 0, 0, 0, 1, False, 0, 0, 0.5, 0.0, False), (5, 1.0, 1.0, 1.0, 1.0, "", "", 0, 0, 0, 0, False, 0, 0, 0.0, 0.0, True),
])
_FOUND = [(2, "BLANK_PAGE", "BLOCKING"), (2, "CONTENT_DENSITY", "BLOCKING"), (2, "CONTENT_DENSITY", "ERROR"), (2, "IMAGE_COVERAGE", "BLOCKING"), (2, "PAGE_GEOMETRY", "BLOCKING"), (3, "CONTENT_DENSITY", "ERROR"), (3, "CORRUPT_GLYPH", "BLOCKING"), (3, "FONT", "BLOCKING"), (3, "FONT", "ERROR"), (3, "OUT_OF_BOUNDS", "BLOCKING"), (3, "OVERLAP", "ERROR"), (4, "FILE_INTEGRITY", "BLOCKING")]
FOUND = Fixture("page bigint, category string, severity string", _FOUND)


@case(f"SELECT * FROM {FOUND.sql}")
def pl17_page_gate(spark, sf):
    return gates.page_findings(PAIRS.df(spark))


@case(f"SELECT page, list(category || ' ' || severity ORDER BY category, severity) AS findings, 'BLOCK' AS verdict FROM {FOUND.sql} GROUP BY page")
def ag07_ag14_report(spark, sf):
    r = gates.report(gates.page_findings(PAIRS.df(spark)), "page")
    return r.withColumn("findings", F.transform("findings", lambda f: F.concat_ws(" ", f["category"], f["severity"])))


@query("""SELECT conv_id // 10 AS chunk, conv_id::VARCHAR AS unit_key, count(*) AS n FROM conversations WHERE turn % 5 <> 4 GROUP BY ALL
UNION ALL SELECT conv_id // 10, NULL, count(*) FROM conversations WHERE turn % 5 = 4 GROUP BY ALL""")
def se05_key_sets(spark, sf):
    """Unit keys of the nested payloads of a review chunk; every fifth turn is malformed."""
    c = tab(spark, sf, "conversations")
    key = F.when(F.col("turn") % 5 != 4, F.col("conv_id").cast("string"))
    payload = F.to_json(F.struct(F.struct(F.struct(key.alias("unit_key")).alias("context")).alias("stage"), F.col("role").alias("padding")))
    return bus.unit_keys(c.select(F.expr("conv_id div 10").alias("chunk"), payload.alias("payload"))).groupBy("chunk", "unit_key").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT doc_id // 10 AS chunk, doc_id AS observation, unnest([doc_id, doc_id + 7]) AS unit_key FROM labels WHERE doc_id % 11 > 0 UNION ALL SELECT doc_id // 10, doc_id, NULL FROM labels WHERE doc_id % 11 = 0)
SELECT chunk, observation, unit_key FROM o WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id // 10 = o.chunk AND d.doc_id = o.unit_key)""")
def se04_unknown_citations(spark, sf):
    """Observations of a chunk of ten documents that cite a document outside it, or none."""
    l = tab(spark, sf, "labels")
    cites = F.when(F.col("doc_id") % 11 > 0, F.array(F.col("doc_id"), F.col("doc_id") + 7)).otherwise(F.array().cast("array<long>"))
    o = l.select(F.expr("doc_id div 10").alias("chunk"), F.col("doc_id").alias("observation"), cites.alias("unit_keys"))
    return bus.unknown_citations(o, docs(spark, sf).select(F.expr("doc_id div 10").alias("chunk"), F.col("doc_id").alias("unit_key"))).select("chunk", "observation", "unit_key")


@query("""WITH o AS (SELECT conv_id AS unit, sha256(text) AS k, turn, role FROM conversations), s AS (SELECT unit, list_sort(list(k)) AS ks FROM o GROUP BY unit),
f AS (SELECT unit, list_sort(list(sha256(unit || '-' || turn))) AS fs FROM o WHERE role = 'user' GROUP BY unit)
SELECT s.unit, sha256(array_to_string(ks, chr(10))) AS option_set_id, ks AS option_keys, coalesce(fs, []) AS finding_ids FROM s LEFT JOIN f ON f.unit = s.unit""")
def so03_review_reports(spark, sf):
    """Review reports with options and findings in the order of their ids."""
    c = tab(spark, sf, "conversations")
    o = c.select(F.col("conv_id").alias("unit"), F.sha2("text", 256).alias("option_key"), F.col("text").alias("target_text"))
    f = c.where("role = 'user'").select(F.col("conv_id").alias("unit"), F.sha2(F.concat_ws("-", "conv_id", "turn"), 256).alias("finding_id"), F.sha2("text", 256).alias("option_key"), F.lit("MINOR").alias("severity"))
    r = bus.report(o, f)
    return r.select("unit", "option_set_id", F.transform("options", lambda x: x["option_key"]).alias("option_keys"), F.transform("findings", lambda x: x["finding_id"]).alias("finding_ids"))


def _directives(spark, sf):
    l = tab(spark, sf, "labels")
    return l.select(F.expr("doc_id div 5").alias("unit"), F.sha2(F.col("doc_id").cast("string"), 256).alias("directive_id"), F.concat(F.lit("r"), F.col("toxic") * 2 + F.col("quality")).alias("term_revision"), "doc_id")


_DIR = "dir AS (SELECT doc_id // 5 AS unit, sha256(doc_id::VARCHAR) AS directive_id, 'r' || (toxic * 2 + quality) AS term_revision, doc_id FROM labels)"


@query(f"""WITH {_DIR}, g AS (SELECT unit, list_sort(list(directive_id)) AS ids, list(CASE term_revision WHEN 'r3' THEN NULL ELSE 'term ' || term_revision END ORDER BY directive_id) AS ts FROM dir GROUP BY unit),
c AS (SELECT unit, list_sort(list(directive_id)) AS ids FROM dir WHERE doc_id % 13 > 0 GROUP BY unit)
SELECT unit, coalesce(g.ids, []) AS directive_ids, coalesce(g.ts, []) AS terms, CASE WHEN coalesce(g.ids, []) <> coalesce(c.ids, []) THEN 'context' WHEN len(list_filter(g.ts, lambda t: t IS NULL)) > 0 THEN 'term' END AS problem FROM g LEFT JOIN c USING (unit)""")
def jn06_guidance(spark, sf):
    """Directives with their term revisions per unit; some contexts lack a directive, one revision is unknown."""
    d = _directives(spark, sf)
    known = spark.createDataFrame([(f"r{i}", f"term r{i}") for i in range(3)], "term_revision string, source_term string")
    context_ = d.where("doc_id % 13 > 0").groupBy("unit").agg(F.collect_list("directive_id").alias("directive_ids"))
    g = terms.guidance(d, known, context_)
    none = F.array().cast("array<string>")
    part = lambda f: F.coalesce(F.transform("guidance", lambda x: x[f]), none)
    return g.select("unit", part("directive_id").alias("directive_ids"), part("source_term").alias("terms"), "problem")


@query(f"WITH {_DIR} SELECT unit, directive_id, term_revision, doc_id AS place FROM dir WHERE unit IN (SELECT conv_id FROM conversations)")
def sp11_directives_of_units(spark, sf):
    u = tab(spark, sf, "conversations").select(F.col("conv_id").alias("unit"))
    return terms.for_unit(_directives(spark, sf).withColumnRenamed("doc_id", "place"), u).select("unit", "directive_id", "term_revision", "place")
