"""Row rules over whole tables: their inputs are made from the rows by arithmetic, their SQL computes the answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers
from ..functions import text as tx
from ..functions import values as vl
from ..operators import constraints, gates, ledger, terms
from ..sources import evidence, records, replies
from .structure_queries import NS, C, FM, O, _attempts, _ATT, _specs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def tab(spark, sf, name) -> DataFrame:
    return records.read_table(spark, sf, name)


def rules(*pairs: tuple[str, str]) -> str:
    """SQL for the names of the rules whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL)"


def pick(i, *values):
    """The value at place ``i`` modulo their number, null for None."""
    return F.get(F.array(*(F.lit(v) for v in values)), (i % len(values)).cast("int"))


def sql_pick(i: str, *values) -> str:
    shown = ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, bool)) else f"'{v}'" for v in values)
    return f"([{shown}])[1 + ({i}) % {len(values)}]"


# --- functions ---

_RISK, _CONV, _SEV = ("R1", "R2", "R3", "R9", None), ("ESTABLISHED", "RARE", "UNATTESTED", "ATTESTED", None, "x"), ("INFO", "MAJOR", "BLOCKING", "CRITICAL", "MINOR")


@query(f"""SELECT event_id, CASE risk WHEN 'R1' THEN 1 WHEN 'R2' THEN 2 WHEN 'R3' THEN 3 END AS risk_rank, CASE conv WHEN 'UNATTESTED' THEN 0 WHEN 'RARE' THEN 1 WHEN 'ATTESTED' THEN 2 WHEN 'ESTABLISHED' THEN 3 END AS conv_rank,
  sev IN ('MAJOR', 'CRITICAL', 'BLOCKING') AS serious, CASE WHEN risk IN ('R1', 'R2', 'R3') THEN risk ELSE 'R1' END AS risk_or_r1, least(30.0, greatest(pow(2, greatest(0, n - 1)), CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END))::DOUBLE AS delay
  FROM (SELECT *, {sql_pick("event_id", *_RISK)} AS risk, {sql_pick("event_id", *_CONV)} AS conv, {sql_pick("event_id", *_SEV)} AS sev, event_id % 9 AS n FROM events)""")
def fn19_fn27_fn30_fn31_event_ranks(spark, sf):
    i = F.col("event_id")
    risk = pick(i, *_RISK)
    return tab(spark, sf, "events").select(
        "event_id", vl.rank_of(risk, vl.RISKS, 1).alias("risk_rank"), vl.rank_of(pick(i, *_CONV), vl.CONVENTIONALITY).alias("conv_rank"), vl.is_serious(pick(i, *_SEV)).alias("serious"),
        vl.enum_or(risk, vl.RISKS, "R1").alias("risk_or_r1"), vl.retry_delay(i % 9, F.when(i % 2 == 0, F.col("value"))).alias("delay"),
    )


#: Texts without letters beyond ASCII, whose word borders all engines see alike.
_ASCII = r"regexp_replace(text, '[^\x00-\x7F]+', '', 'g')"


@query(rf"""WITH s AS (SELECT conv_id, turn, {_ASCII} AS s, (conv_id + turn) % 6 AS k FROM conversations),
t AS (SELECT *, CASE k WHEN 0 THEN s WHEN 1 THEN '热量向下流动' WHEN 2 THEN left(s, (length(s) * 9 // 10)::INT) || ' 热' WHEN 3 THEN s || ' ' || repeat('热', (length(s) // 2)::INT) WHEN 4 THEN upper(s) ELSE left(s, (length(s) // 2)::INT) END AS t, CASE WHEN k = 4 AND turn % 2 = 0 THEN 'de' ELSE 'zh-Hans' END AS lang FROM s),
w AS (SELECT *, regexp_extract_all(s, '(?i)\b[A-Z][A-Z''-]{{1,}}\b') AS ws, len(regexp_extract_all(t, '[㐀-鿿]')) AS cjk FROM t),
k AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: regexp_matches(t, '(?i)\b' || w || '\b'))) AS kept FROM w)
SELECT conv_id, turn, lang LIKE 'zh%' AND n > 0 AND (lower(trim(regexp_replace(s, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) OR (n >= 2 AND kept >= 0.8 * n AND cjk < greatest(4, n * 2)) OR (n = 1 AND kept = 1 AND cjk = 0)) AS blocked FROM k""")
def fn20_untranslated_turns(spark, sf):
    """Turns against targets that repeat them, translate them, or stop on the way."""
    s = F.regexp_replace("text", r"[^\x00-\x7F]+", "")
    k, n = (F.col("conv_id") + F.col("turn")) % 6, F.length("s")
    part = lambda m: F.left("s", m.cast("int"))
    t = F.when(k == 0, F.col("s")).when(k == 1, "热量向下流动").when(k == 2, F.concat(part(F.floor(n * 9 / 10)), F.lit(" 热"))).when(k == 3, F.concat("s", F.lit(" "), F.repeat(F.lit("热"), F.floor(n / 2).cast("int"))))
    t = t.when(k == 4, F.upper("s")).otherwise(part(F.floor(n / 2)))
    lang = F.when((k == 4) & (F.col("turn") % 2 == 0), "de").otherwise("zh-Hans")
    none = F.array().cast("array<string>")
    return tab(spark, sf, "conversations").withColumn("s", s).select("conv_id", "turn", tx.untranslated(F.col("s"), t, lang, none, none, none).alias("blocked"))


@query("SELECT vec_id, len(list_filter(p, lambda x: x < 245)) / len(p)::DOUBLE AS ink FROM (SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x::DOUBLE) * 5000)::BIGINT % 300)) AS p FROM embeddings)")
def fn29_embedding_ink(spark, sf):
    px = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 5000) % 300)
    return tab(spark, sf, "embeddings").select("vec_id", vl.ink_ratio(px).alias("ink"))


# --- evidence ---


@query(rf"""WITH e AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN ' ' ELSE 'Exam' END AS form, CASE WHEN page_id % 11 = 0 THEN 'nothing' ELSE url END AS excerpt, CASE page_id % 5 WHEN 0 THEN upper(sha256(url)) WHEN 1 THEN 'k' ELSE sha256(url) END AS k,
  CASE page_id % 7 WHEN 0 THEN 'ftp://a.org' WHEN 1 THEN NULL WHEN 2 THEN 'urn:x:' || page_id ELSE url END AS uri, CASE page_id % 6 WHEN 0 THEN '2023-02-29' WHEN 1 THEN '2024-2-1' ELSE '2024-02-' || lpad((page_id % 29 + 1)::VARCHAR, 2, '0') END AS day FROM pages)
SELECT page_id, {rules(("trim(form) = '' OR trim(excerpt) = ''", "blank text"), ("NOT regexp_full_match(k, '[0-9a-f]{64}')", "source key"), (r"NOT coalesce(regexp_matches(uri, '^(https?://[^\s/?#]+|urn:\S+)'), false)", "uri"),
  ("NOT regexp_full_match(day, '\\d{4}-\\d{2}-\\d{2}') OR try_cast(day AS DATE) IS NULL", "date"), ("NOT contains(lower(excerpt), lower(form))", "excerpt lacks target"))} AS problems FROM e""")
def src06_page_evidence(spark, sf):
    i, u = F.col("page_id"), F.col("url")
    day = F.when(i % 6 == 0, "2023-02-29").when(i % 6 == 1, "2024-2-1").otherwise(F.concat(F.lit("2024-02-"), F.lpad((i % 29 + 1).cast("string"), 2, "0")))
    e = tab(spark, sf, "pages").select(
        "page_id", F.when(i % 13 == 0, " ").otherwise("Exam").alias("target_form"), F.when(i % 11 == 0, "nothing").otherwise(u).alias("excerpt"),
        F.when(i % 5 == 0, F.upper(F.sha2(u, 256))).when(i % 5 == 1, "k").otherwise(F.sha2(u, 256)).alias("source_key"),
        F.when(i % 7 == 0, "ftp://a.org").when(i % 7 == 1, None).when(i % 7 == 2, F.concat(F.lit("urn:x:"), i)).otherwise(u).alias("source_uri"), day.alias("retrieved_on"),
    )
    return e.select("page_id", evidence.problems().alias("problems"))


_FITS = ("CONFIRMED", "UNRESOLVED", "REJECTED")


@query(f"""SELECT page_id, {rules(("fit = 'CONFIRMED' AND page_id % 4 < 1", "unsupported"), ("page_id % 5 = 0", "uri"))} AS problems FROM (SELECT page_id, {sql_pick("page_id", *_FITS)} AS fit FROM pages)""")
def pr13_page_support(spark, sf):
    i = F.col("page_id")
    uri = F.when(i % 5 == 0, F.concat(F.lit("file:"), "url")).otherwise(F.col("url"))
    return tab(spark, sf, "pages").select("page_id", terms.evidence_problems(pick(i, *_FITS), i % 4, uri).alias("problems"))


_CONF = ("VERIFIED", "SUPPORTED", "PROVISIONAL", "RETAINED_UNRESOLVED")
_TREAT = ("TRANSLATE_ONLY", "TRANSLATE_WITH_SOURCE_FIRST", "RETAIN_SOURCE")
_CONV4 = ("UNATTESTED", "RARE", "ATTESTED", "ESTABLISHED")


@query(f"""WITH d AS (SELECT page_id AS i, {sql_pick("page_id", *_CONF)} AS conf, page_id % 6 = 0 AS same, page_id // 2 % 4 AS n, page_id // 3 % 2 AS strong, page_id % 7 = 0 AS contra, page_id // 5 % 4 AS conv, {sql_pick("page_id // 4", *_FITS)} AS fit, page_id // 7 % 4 AS best,
  CASE WHEN page_id % 9 = 0 THEN 'accuracy' ELSE ' ' END AS why, page_id % 8 = 0 AS kept FROM pages)
SELECT i AS page_id, {rules(("same", "same actor"), ("conf <> 'RETAINED_UNRESOLVED' AND fit <> 'CONFIRMED'", "fit"), ("conf = 'VERIFIED' AND (n < 2 OR strong < 1 OR contra)", "verified evidence"), ("conf = 'VERIFIED' AND conv < 2", "verified form"),
  ("conf = 'SUPPORTED' AND (n < 1 OR (strong < 1 AND n < 2) OR contra)", "supported evidence"), ("conf = 'PROVISIONAL' AND n < 1", "no attestation"), ("conf = 'RETAINED_UNRESOLVED' AND NOT kept", "not retained"),
  ("conf <> 'RETAINED_UNRESOLVED' AND best > conv AND trim(why) = ''", "mainstream"))} AS problems FROM d""")
def pr11_page_decisions(spark, sf):
    i = F.col("page_id")
    part = lambda k, m: F.floor(i / k) % m
    p = constraints.decision_problems(
        pick(i, *_CONF), F.lit("a"), F.when(i % 6 == 0, "a").otherwise("b"), part(2, 4), part(3, 2), i % 7 == 0, pick(F.floor(i / 5), *_CONV4), pick(F.floor(i / 4), *_FITS), part(7, 4),
        F.when(i % 9 == 0, "accuracy").otherwise(" "), F.when(i % 8 == 0, "t").otherwise("f"), F.lit("t"),
    )
    return tab(spark, sf, "pages").select("page_id", p.alias("problems"))


@query(f"""SELECT doc_id, {rules(("tr = 'TRANSLATE_ONLY' AND conf <> 'VERIFIED'", "needs source"), ("(conf = 'RETAINED_UNRESOLVED') <> (tr = 'RETAIN_SOURCE')", "retention"))} AS problems FROM (SELECT doc_id, {sql_pick("doc_id", *_TREAT)} AS tr, {sql_pick("doc_id", *_CONF)} AS conf FROM documents)""")
def pr12_document_treatments(spark, sf):
    i = F.col("doc_id")
    return tab(spark, sf, "documents").select("doc_id", constraints.treatment_problems(pick(i, *_TREAT), pick(i, *_CONF)).alias("problems"))


@query(f"""WITH d AS (SELECT doc_id, lang, source, {sql_pick("doc_id", *_CONF)} AS conf, doc_id = min(doc_id) OVER (PARTITION BY source) AS f FROM documents)
SELECT doc_id, CASE conf WHEN 'VERIFIED' THEN 'TRANSLATE_ONLY' WHEN 'RETAINED_UNRESOLVED' THEN 'RETAIN_SOURCE' ELSE 'TRANSLATE_WITH_SOURCE_FIRST' END AS treatment,
  CASE WHEN conf = 'RETAINED_UNRESOLVED' THEN source WHEN conf <> 'VERIFIED' AND f THEN lang || '（' || source || '）' ELSE lang END AS rendering FROM d""")
def sp03_so04_document_renderings(spark, sf):
    """Sources as terms, languages as their forms; the first document of a source is its first use."""
    d = tab(spark, sf, "documents").select("doc_id", F.col("lang").alias("form"), F.col("source").alias("term"), pick(F.col("doc_id"), *_CONF).alias("conf"))
    t = terms.treatment(F.col("conf"))
    return terms.with_first_use(d, "term", ("doc_id",)).select("doc_id", t.alias("treatment"), terms.rendering(t, F.col("first_use"), F.col("form"), F.col("term")).alias("rendering"))


@query("""WITH c AS (SELECT regexp_extract(text, '[A-Za-z]+') AS term, lang AS sense, [regexp_extract(text, '[A-Za-z]+'), source] AS forms, doc_id FROM documents)
SELECT term AS source_term, arg_max(sense, doc_id) AS sense_id, list_filter(arg_max(forms, doc_id), lambda x: x <> term) AS forms FROM c WHERE term <> '' AND len(list_filter(forms, lambda x: x <> term)) > 0 GROUP BY term HAVING count(DISTINCT sense) = 1""")
def ag09_document_concepts(spark, sf):
    """First words as terms, languages as senses: those with one sense remain, with their last forms."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    c = tab(spark, sf, "documents").select(word.alias("source_term"), F.col("lang").alias("sense_id"), F.array(word, "source").alias("forms"), F.col("doc_id").alias("seq"))
    return terms.clear_concepts(c.where("source_term IS NOT NULL"))


_EV = "SELECT page_id, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS term, 'f' || page_id AS form"


@query(f"""WITH c AS ({_EV}, {sql_pick("page_id", *_FITS)} AS fit, page_id // 3 % 4 AS conv, page_id % 5 AS evidence_rank, page_id % 6 = 0 AS sel, CASE WHEN page_id % 48 = 0 THEN 'why' ELSE '' END AS ov FROM pages),
b AS (SELECT term, max(conv) FILTER (fit = 'CONFIRMED') AS br, max([conv, evidence_rank]) FILTER (fit = 'CONFIRMED') AS top, max(form) FILTER (sel AND fit = 'CONFIRMED') AS own, max(conv) FILTER (sel AND fit = 'CONFIRMED') AS own_rank, max(ov) AS ov FROM c GROUP BY term),
m AS (SELECT c.term, max(c.form) AS best FROM c JOIN b ON b.term = c.term AND c.fit = 'CONFIRMED' AND [c.conv, c.evidence_rank] = b.top GROUP BY c.term)
SELECT b.term, CASE WHEN own IS NOT NULL AND (own_rank >= br OR trim(ov) <> '') THEN own WHEN br IS NOT NULL THEN m.best ELSE b.term END AS form FROM b LEFT JOIN m ON m.term = b.term""")
def so02_page_choices(spark, sf):
    """Forms of a term with a reviewer's choice, which a more conventional form beats unless it is overridden."""
    i = F.col("page_id")
    c = tab(spark, sf, "pages").select(
        F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("term"), F.concat(F.lit("f"), i).alias("form"), pick(i, *_FITS).alias("fit"), pick(F.floor(i / 3), *_CONV4).alias("conventionality"),
        (i % 5).alias("evidence_rank"), (i % 6 == 0).alias("selected"), F.when(i % 48 == 0, "why").otherwise("").alias("override"),
    )
    return terms.select_form(c)


# --- placeholders, records, routes, plans ---

_TOK = (O, C, FM)


def _damage(i, text):
    """A text with its tokens, whole or damaged in one of eight ways."""
    a, b = F.left(text, F.lit(7)), F.substring(text, 8, 9)
    forms = [(O, a, C, b, FM), (O, a, C, b), (O, a, C, FM, FM, b), (O, a, C, FM, f"[[{NS}:F:0009]]"), (FM, O, a, C), (O, F.lit(" "), C, FM, b), (C, a, O, b, FM), (O, a, C, FM, f" [[{NS}:F:00")]
    out = F.lit(None).cast("string")
    for k, parts in enumerate(forms):
        out = F.when(i % 8 == k, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise(out)
    return out


_A, _B = "left(text, 7)", "substr(text, 8, 9)"
_FORMS = [f"'{O}' || {_A} || '{C}' || {_B} || '{FM}'", f"'{O}' || {_A} || '{C}' || {_B}", f"'{O}' || {_A} || '{C}{FM}{FM}' || {_B}", f"'{O}' || {_A} || '{C}{FM}[[{NS}:F:0009]]'", f"'{FM}{O}' || {_A} || '{C}'",
          f"'{O} {C}{FM}' || {_B}", f"'{C}' || {_A} || '{O}' || {_B} || '{FM}'", f"'{O}' || {_A} || '{C}{FM} [[{NS}:F:00'"]
_PLACES = f"list_filter([{', '.join(f'''strpos(t, '{x}')''' for x in _TOK)}], lambda p: p > 0)"


@query(f"""WITH d AS (SELECT conv_id, turn, CASE (conv_id + turn) % 8 {" ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(_FORMS))} END AS t FROM conversations),
e AS (SELECT *, regexp_extract_all(t, '\\[\\[{NS}:(?s:.*?)\\]\\]') AS found, {_PLACES} AS places, strpos(t, '{O}') AS o, strpos(t, '{C}') AS c FROM d)
SELECT conv_id, turn, {rules((" OR ".join(f"(length(t) - length(replace(t, '{x}', ''))) // {len(x)} <> 1" for x in _TOK), "count"), (f"(length(t) - length(replace(t, '[[{NS}:', ''))) // {len(NS) + 3} > len(found)", "unterminated"),
  (f"list_sort(found) <> list_sort(['{O}', '{C}', '{FM}'])", "invented"), ("places <> list_sort(places)", "order"),
  (f"o > 0 AND c > 0 AND (c < o + {len(O)} OR regexp_full_match(substr(t, o + {len(O)}, c - o - {len(O)}), '[\\s\\x0B\\x{{85}}\\p{{Z}}]*'))", "empty style"))} AS problems FROM e""")
def pr01_damaged_turns(spark, sf):
    c = tab(spark, sf, "conversations")
    return c.select("conv_id", "turn", constraints.placeholder_problems(_damage(F.col("conv_id") + F.col("turn"), F.col("text")), F.lit(NS), _specs()).alias("problems"))


_SPACES, _OPEN, _SHUT = (NS, "PT2-xyz", NS, NS), (O, O, FM), (C, O, None, f"[[{NS}:S:0002:CLOSE]]")


@query(f"""WITH d AS (SELECT doc_id, {sql_pick("doc_id", *_SPACES)} AS ns, {sql_pick("doc_id", *_OPEN)} AS a, {sql_pick("doc_id // 3", *_SHUT)} AS b, CASE WHEN doc_id % 2 = 0 THEN 'rich_style' ELSE 'formula' END AS kind FROM documents)
SELECT doc_id, {rules(("NOT regexp_full_match(ns, 'PT2-[0-9a-f]{12}')", "namespace"), ("a = b", "tokens repeat"),
  (r"NOT coalesce(CASE WHEN kind = 'formula' THEN b IS NULL AND regexp_full_match(a, '\[\[' || ns || ':F:\d{4,}\]\]') ELSE regexp_full_match(a, '\[\[' || ns || ':S:\d{4,}:OPEN\]\]') AND regexp_full_match(b, '\[\[' || ns || ':S:\d{4,}:CLOSE\]\]') AND regexp_extract(a, ':S:(\d+)', 1) = regexp_extract(b, ':S:(\d+)', 1) END, false)", "token shape"))} AS problems FROM d""")
def pr02_document_contracts(spark, sf):
    i = F.col("doc_id")
    spec = F.struct(F.when(i % 2 == 0, "rich_style").otherwise("formula").alias("kind"), pick(i, *_OPEN).alias("open_token"), pick(F.floor(i / 3), *_SHUT).alias("close_token"))
    return tab(spark, sf, "documents").select("doc_id", constraints.contract_problems(pick(i, *_SPACES), F.array(spec)).alias("problems"))


_REASONS = ("TEXT", "EMPTY", "PURE_NUMERIC", "MISSING_GEOMETRY", "VERTICAL_TEXT_UNSUPPORTED", "UNKNOWN_COMPOSITION", "nonsense")
_DISP = ("translatable", "safe_exclusion", "blocker")


@query(f"""WITH d AS (SELECT doc_id, {sql_pick("doc_id // 2", *_DISP)} AS d, {sql_pick("doc_id", *_REASONS)} AS r, doc_id % 5 < 3 AS u, doc_id % 4 > 0 AS b, doc_id % 9 = 0 AS v FROM documents)
SELECT doc_id, {rules(("NOT ((d = 'translatable' AND r = 'TEXT') OR (d = 'safe_exclusion' AND r IN ('EMPTY', 'PURE_NUMERIC', 'FORMULA_ONLY', 'DEBUG_ARTIFACT')) OR (d = 'blocker' AND r IN ('VERTICAL_TEXT_UNSUPPORTED', 'UNKNOWN_COMPOSITION', 'MISSING_GEOMETRY')))", "reason"),
  ("(d = 'translatable') <> u", "unit"), ("(r = 'MISSING_GEOMETRY') = b", "box"), ("r = 'VERTICAL_TEXT_UNSUPPORTED' AND NOT v", "vertical"))} AS problems FROM d""")
def pr03_document_records(spark, sf):
    i = F.col("doc_id")
    return tab(spark, sf, "documents").select("doc_id", constraints.record_problems(pick(F.floor(i / 2), *_DISP), pick(i, *_REASONS), i % 5 < 3, i % 4 > 0, i % 9 == 0).alias("problems"))


@query(f"""WITH d AS (SELECT doc_id, 'R' || (doc_id % 3 + 1) AS level, list_transform(range(0, doc_id // 3 % 5), lambda x: 'l' || (x % (1 + doc_id % 4))) AS lanes, doc_id % 2 AS n FROM documents)
SELECT doc_id, {rules(("len(lanes) NOT BETWEEN 1 AND 3", "lane count"), ("len(lanes) <> len(list_distinct(lanes))", "lanes repeat"), ("level = 'R1' AND len(lanes) <> 1", "R1 lanes"), ("level = 'R3' AND len(lanes) < 2", "R3 lanes"), ("level <> 'R1' AND n = 0", "reasons"))} AS problems FROM d""")
def pr09_document_routes(spark, sf):
    i = F.col("doc_id")
    n = (F.floor(i / 3) % 5).cast("int")
    lanes = F.transform(F.slice(F.array(*(F.lit(x) for x in range(5))), F.lit(1), n), lambda x: F.concat(F.lit("l"), x % (1 + i % 4)))
    reasons = F.when(i % 2 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return tab(spark, sf, "documents").select("doc_id", constraints.route_problems(F.concat(F.lit("R"), i % 3 + 1), lanes, reasons).alias("problems"))


_ROLES = ("TRANSLATOR", "BILINGUAL_REVIEWER", "ADJUDICATOR", "EDITOR")


@query(f"""WITH u AS (SELECT doc_id AS k, n_chars AS rev FROM documents), r AS (SELECT conv_id AS k, CASE WHEN conv_id % 7 = 0 THEN -1 ELSE d.n_chars END AS rev, 'lane' || turn % 4 AS lane FROM conversations LEFT JOIN documents d ON d.doc_id = conv_id),
a AS (SELECT 'a' || user_id AS actor, {sql_pick("event_id", *_ROLES)} AS role FROM events WHERE event_id % 3 = 0), g AS (SELECT k, count(*) AS n, max(rev) AS got FROM r GROUP BY k)
SELECT problem, subject FROM (SELECT CASE WHEN n IS NULL THEN 'missing' WHEN u.k IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' WHEN got <> rev THEN 'stale' END AS problem, coalesce(u.k, g.k)::VARCHAR AS subject FROM u FULL JOIN g ON g.k = u.k) WHERE problem IS NOT NULL
UNION ALL SELECT DISTINCT 'unknown lane', lane FROM r WHERE lane NOT IN ('lane0', 'lane1') UNION ALL SELECT 'shared actor', actor FROM a GROUP BY actor HAVING bool_or(role = 'TRANSLATOR') AND bool_or(role = 'BILINGUAL_REVIEWER')""")
def pr10_se02_plans(spark, sf):
    """Documents as units, turns as their routes, users as actors."""
    d = tab(spark, sf, "documents").select(F.col("doc_id").alias("unit_key"), F.col("n_chars").alias("unit_revision"))
    c = tab(spark, sf, "conversations").select(F.col("conv_id").alias("unit_key"), "turn").join(d, "unit_key", "left")
    r = c.select("unit_key", F.when(F.col("unit_key") % 7 == 0, -1).otherwise(F.col("unit_revision")).alias("unit_revision"), F.array(F.concat(F.lit("lane"), F.col("turn") % 4)).alias("lane_keys"))
    lanes = spark.createDataFrame([("lane0",), ("lane1",)], "lane_key string")
    a = tab(spark, sf, "events").where("event_id % 3 = 0").select(F.concat(F.lit("a"), "user_id").alias("actor_key"), pick(F.col("event_id"), *_ROLES).alias("role"))
    return constraints.plan_problems(r, d, lanes, a)


@query("SELECT user_id, s, e FROM (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM (SELECT user_id, event_id * 7 % 1009 AS s, event_id * 7 % 1009 + event_id % 13 + 1 AS e FROM events)) WHERE u > s")
def pr14_wn05_event_overlaps(spark, sf):
    s = F.col("event_id") * 7 % 1009
    return constraints.overlapping(tab(spark, sf, "events").select("user_id", s.alias("s"), (s + F.col("event_id") % 13 + 1).alias("e")), "user_id")


@query(f"""WITH d AS (SELECT item_id, text, item_id % 9 - 1 AS s, item_id % 9 - 1 + item_id % 12 AS e, CASE WHEN item_id % 7 = 0 THEN 'other' ELSE substr(text, (item_id % 9)::BIGINT, (item_id % 12)::BIGINT) END AS q FROM benchmark),
f AS (SELECT *, s >= 0 AND s < e AND e <= length(text) AS inside, substr(text, s + 1, e - s) AS cut FROM d)
SELECT item_id, {rules(("NOT inside", "bounds"), ("inside AND cut <> q", "slice"), ("inside AND trim(cut) = ''", "blank"))} AS problems FROM f""")
def pr19_benchmark_spans(spark, sf):
    i = F.col("item_id")
    s, e = (i % 9 - 1).cast("int"), (i % 9 - 1 + i % 12).cast("int")
    q = F.when(i % 7 == 0, "other").otherwise(F.substring("text", s + 1, e - s))
    return tab(spark, sf, "benchmark").select("item_id", constraints.span_problems(F.col("text"), s, e, q).alias("problems"))


_ACTS = ("AVOIDED", "CORRECTED", "FALSE_POSITIVE", "PRESERVED_SOURCE_AMBIGUITY", "none")
_SER = "list_filter(fs, lambda f: f.s IN ('MAJOR', 'CRITICAL', 'BLOCKING'))"


@query(f"""WITH d AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'SYNTHESIZE' ELSE 'SELECT' END AS mode, CASE WHEN conv_id % 4 > 0 THEN 'o' || conv_id % 2 END AS sel,
  list(struct_pack(f := 'f' || turn, o := 'o' || turn % 2, s := {sql_pick("conv_id + turn", *_SEV)}) ORDER BY turn) AS fs, list(struct_pack(f := 'f' || CASE WHEN turn = 3 AND conv_id % 5 = 0 THEN 99 ELSE turn END, a := {sql_pick("conv_id // 2 + turn", *_ACTS)}) ORDER BY turn) AS rs FROM conversations GROUP BY conv_id),
r AS (SELECT *, list_filter(rs, lambda r: r.a <> 'none') AS done FROM d),
k AS (SELECT *, list_transform({_SER}, lambda f: struct_pack(s := f.s, own := coalesce(f.o = sel, false), a := list_filter(done, lambda r: r.f = f.f)[1].a)) AS ser FROM r)
SELECT conv_id, {rules(("mode = 'SELECT' AND sel IS NULL", "no selection"), ("mode <> 'SELECT' AND sel IS NOT NULL", "synthesis selects"), ("len(list_filter(done, lambda r: NOT list_contains(list_transform(fs, lambda f: f.f), r.f))) > 0", "unknown finding"),
  ("len(list_filter(ser, lambda x: x.a IS NULL)) > 0", "unresolved"), ("mode = 'SELECT' AND len(list_filter(ser, lambda x: NOT x.own AND x.a NOT IN ('AVOIDED', 'FALSE_POSITIVE'))) > 0", "other option"),
  ("mode = 'SELECT' AND len(list_filter(ser, lambda x: x.own AND x.a NOT IN ('FALSE_POSITIVE', 'PRESERVED_SOURCE_AMBIGUITY'))) > 0", "own text"), ("mode = 'SELECT' AND len(list_filter(ser, lambda x: x.own AND x.s IN ('CRITICAL', 'BLOCKING') AND x.a <> 'FALSE_POSITIVE')) > 0", "critical stays"),
  ("mode <> 'SELECT' AND len(list_filter(ser, lambda x: x.a = 'AVOIDED')) > 0", "synthesis avoids"))} AS problems FROM k""")
def pr15_pr16_turn_adjudications(spark, sf):
    """Turns as findings about two options, with a resolution for most of them."""
    i, t = F.col("conv_id"), F.col("turn")
    f = F.struct(F.concat(F.lit("f"), t).alias("finding_id"), F.concat(F.lit("o"), t % 2).alias("option_key"), pick(i + t, *_SEV).alias("severity"))
    r = F.struct(F.concat(F.lit("f"), F.when((t == 3) & (i % 5 == 0), 99).otherwise(t)).alias("finding_id"), pick(F.floor(i / 2) + t, *_ACTS).alias("action"))
    c = tab(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", f.alias("f"), r.alias("r")))).alias("x"))
    found = F.transform("x", lambda x: x["f"])
    done = F.filter(F.transform("x", lambda x: x["r"]), lambda x: x["action"] != "none")
    mode, sel = F.when(i % 3 == 0, "SYNTHESIZE").otherwise("SELECT"), F.when(i % 4 > 0, F.concat(F.lit("o"), i % 2))
    return c.select("conv_id", constraints.adjudication_problems(mode, sel, found, done).alias("problems"))


_IMPACT = ("EQUIVALENT", "IMPROVES", "DEGRADES")


@query(f"""SELECT conv_id, turn, {rules(("conv_id % 2 = 0 AND impact <> 'EQUIVALENT'", "unchanged"), ("(turn % 2 = 0) <> (NOT serious AND impact <> 'DEGRADES')", "verdict"))} AS problems FROM (SELECT *, {sql_pick("conv_id + turn", *_IMPACT)} AS impact, conv_id % 5 = 0 AS serious FROM conversations)""")
def pr17_pr18_turn_verdicts(spark, sf):
    i, t = F.col("conv_id"), F.col("turn")
    return tab(spark, sf, "conversations").select("conv_id", "turn", constraints.verdict_problems(F.when(t % 2 == 0, "PASS").otherwise("BLOCK"), i % 5 == 0, pick(i + t, *_IMPACT), i % 2 > 0).alias("problems"))


# --- spans and markers ---


@query(r"""WITH t AS (SELECT conv_id, turn, nfc_normalize(text) AS text, conv_id || '-' || turn AS key, (conv_id + turn) % 6 AS k FROM conversations),
w AS (SELECT *, substr(text, 4, 5) AS r FROM t), m AS (SELECT *, '⟪T:' || key || '⟫' AS o, '⟪/T:' || key || '⟫' AS c FROM w),
d AS (SELECT *, left(text, 3) || CASE k WHEN 0 THEN o || r || c WHEN 1 THEN o || r WHEN 2 THEN r || c WHEN 3 THEN o || r || 'x' || c WHEN 4 THEN '⟪T:zz⟫' || r ELSE r END || substr(text, 9) AS marked FROM m),
x AS (SELECT *, regexp_extract_all(marked, '⟪(/?T:[^⟪⟫]+)⟫', 1) AS found FROM d),
p AS (SELECT *, CASE WHEN len(list_filter(found, lambda f: regexp_replace(f, '^/?T:', '') <> key)) > 0 THEN 'unknown marker' WHEN len(found) = 1 AND left(found[1], 1) <> '/' THEN 'not closed' WHEN len(found) = 1 THEN 'unbalanced'
  WHEN len(found) = 0 THEN 'missing marker' WHEN substr(marked, strpos(marked, o) + length(o), strpos(marked, c) - strpos(marked, o) - length(o)) <> r THEN 'wrong rendering' END AS problem FROM x)
SELECT conv_id, turn, problem, CASE WHEN problem IS NULL THEN sha256(replace(replace(marked, o, ''), c, '')) END AS text_sha, CASE WHEN problem IS NULL THEN strpos(marked, o) - 1 END::INT AS s, CASE WHEN problem IS NULL THEN strpos(marked, o) - 1 + length(r) END::INT AS e FROM p""")
def sp05_marked_turns(spark, sf):
    """Turns with a marked term, whole or without one of its markers, with another rendering or another key."""
    text, k = tx.normalize_text(F.col("text")), (F.col("conv_id") + F.col("turn")) % 6
    c = tab(spark, sf, "conversations").select("conv_id", "turn", text.alias("t"), F.concat_ws("-", "conv_id", "turn").alias("key"), k.alias("k"))
    c = c.withColumns({"r": F.substring("t", 4, 5), "o": F.concat(F.lit("⟪T:"), "key", F.lit("⟫")), "c": F.concat(F.lit("⟪/T:"), "key", F.lit("⟫"))})
    inner = F.when(F.col("k") == 0, F.concat("o", "r", "c")).when(F.col("k") == 1, F.concat("o", "r")).when(F.col("k") == 2, F.concat("r", "c")).when(F.col("k") == 3, F.concat("o", "r", F.lit("x"), "c")).when(F.col("k") == 4, F.concat(F.lit("⟪T:zz⟫"), "r")).otherwise(F.col("r"))
    marked = F.concat(F.left("t", F.lit(3)), inner, F.substring("t", 9, 2**30))
    d = c.select("conv_id", "turn", markers.decode_marked(marked, F.create_map("key", "r")).alias("d"))
    return d.select("conv_id", "turn", "d.problem", F.sha2("d.text", 256).alias("text_sha"), F.get("d.spans", F.lit(0))["s"].alias("s"), F.get("d.spans", F.lit(0))["e"].alias("e"))


@query(r"""WITH d AS (SELECT item_id, nfc_normalize(text) AS t, CASE item_id % 6 WHEN 0 THEN 'zzzz' WHEN 1 THEN ' ' ELSE substr(nfc_normalize(text), (item_id % 11 + 1)::BIGINT, (item_id % 7 + 2)::BIGINT) END AS q0, CASE item_id % 4 WHEN 0 THEN item_id % 11 WHEN 1 THEN 9999 WHEN 2 THEN NULL ELSE -1 END AS decl FROM benchmark),
q AS (SELECT *, trim(q0) AS q FROM d), n AS (SELECT *, length(q) AS n, strpos(t, q) AS f FROM q),
a AS (SELECT *, CASE WHEN q = '' THEN NULL WHEN coalesce(decl >= 0 AND decl <= length(t) - n AND substr(t, decl + 1, n) = q, false) THEN decl WHEN f > 0 AND strpos(substr(t, f + n), q) = 0 THEN f - 1 END AS s FROM n)
SELECT item_id, s::INT AS s, (s + n)::INT AS e, CASE WHEN q <> '' AND s IS NULL THEN 'absent or ambiguous' END AS problem FROM a""")
def sp06_sp04_benchmark_quotes(spark, sf):
    """Quotations of benchmark texts with a place that is right, out of range, missing or negative."""
    i, t = F.col("item_id"), tx.normalize_text(F.col("text"))
    q = F.when(i % 6 == 0, "zzzz").when(i % 6 == 1, " ").otherwise(F.substring("t", (i % 11 + 1).cast("int"), (i % 7 + 2).cast("int")))
    decl = F.when(i % 4 == 0, i % 11).when(i % 4 == 1, 9999).when(i % 4 == 2, None).otherwise(-1)
    b = tab(spark, sf, "benchmark").select("item_id", t.alias("t")).withColumns({"q": q, "decl": decl.cast("int")})
    return b.select("item_id", markers.quote_span(F.col("t"), F.col("q"), F.col("decl")).alias("x")).select("item_id", "x.*")


# --- calls ---


@query("SELECT event_id, event_type IN ('rate_limit') OR kind IN ('rate_limit', 'transient', 'timeout', 'connection', 'os_error') AS retry, CASE WHEN code = 429 THEN 'rate_limit' WHEN code IN (408, 409) OR code >= 500 THEN 'transient' WHEN code >= 400 THEN 'permanent' ELSE 'ok' END AS class, "
       "CASE WHEN code = 429 THEN try_cast(hint AS DOUBLE) END AS wait FROM (SELECT *, " + sql_pick("event_id", "timeout", "value", "os_error", "rate_limit", "x", "connection", "transient") + " AS kind, " + sql_pick("event_id // 3", 200, 404, 408, 409, 429, 500, 503) + " AS code, CASE WHEN event_id % 2 = 0 THEN value::VARCHAR ELSE 'soon' END AS hint FROM events)")  # fmt: skip
def st05_src18_event_errors(spark, sf):
    i = F.col("event_id")
    code = pick(F.floor(i / 3), 200, 404, 408, 409, 429, 500, 503)
    hint = F.when(i % 2 == 0, F.col("value").cast("string")).otherwise("soon")
    kind = pick(i, "timeout", "value", "os_error", "rate_limit", "x", "connection", "transient")
    return tab(spark, sf, "events").select("event_id", ledger.classify_error(kind).alias("retry"), ledger.retryable_status(code).alias("class"), replies.retry_hint(code, hint).alias("wait"))


@query(f"""WITH {_ATT}, l AS (SELECT call, 't' || event_id AS token, ts AS a, ts + INTERVAL 2 HOUR AS b, event_id FROM att WHERE outcome <> 'SUCCEEDED'),
c AS (SELECT call, event_id, 't' || coalesce(lag(event_id) OVER (PARTITION BY call ORDER BY ts, event_id), event_id) AS token, ts AS d, outcome FROM att),
j AS (SELECT c.call, c.token, c.d, arg_max(l.token, l.a) AS now, max(l.a) AS a, arg_max(l.b, l.a) AS b FROM c LEFT JOIN l ON l.call = c.call AND l.a <= c.d WHERE c.outcome = 'SUCCEEDED' GROUP BY c.call, c.token, c.d)
SELECT call, token, d AS done_at, coalesce(now = token AND d < b, false) AS valid FROM j""")
def st04_st12_event_fencing(spark, sf):
    """Purchases as commits under the token of the user's last event of the day; every other event takes a lease of two hours."""
    from pyspark.sql import Window

    a = _attempts(spark, sf)
    token = F.concat(F.lit("t"), F.coalesce(F.lag("event_id").over(Window.partitionBy("call").orderBy("ts", "event_id")), "event_id"))
    c = a.withColumn("token", token).where("outcome = 'SUCCEEDED'").select("call", "token", F.col("ts").alias("done_at"))
    l = a.where("outcome <> 'SUCCEEDED'").select("call", F.concat(F.lit("t"), "event_id").alias("token"), F.col("ts").alias("acquired_at"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("expires_at"))
    return ledger.fenced_commits(c, l)


@query("""WITH s AS (SELECT doc_id AS scope, source AS caps FROM documents WHERE doc_id % 3 > 0), i AS (SELECT doc_id AS scope, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE source END AS caps FROM documents)
SELECT i.scope, CASE WHEN s.scope IS NULL THEN 'new' WHEN s.caps IS DISTINCT FROM i.caps THEN 'conflict' ELSE 'replay' END AS state FROM i LEFT JOIN s ON s.scope = i.scope""")
def st07_document_policies(spark, sf):
    d = tab(spark, sf, "documents").select(F.col("doc_id").alias("scope"), F.col("source").alias("caps"))
    return ledger.write_once(d.where("scope % 3 > 0"), d.withColumn("caps", F.when(F.col("scope") % 7 == 0, "other").otherwise(F.col("caps"))), "scope", "caps")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'BLOCKED' WHEN doc_id % 5 = 0 THEN 'RELEASED' WHEN doc_id % 3 = 0 THEN 'BLOCKED' WHEN doc_id % 4 = 0 THEN 'VERIFYING' WHEN doc_id % 7 > 0 THEN 'IN_PROGRESS' ELSE 'NEW' END AS state FROM documents""")
def so01_document_states(spark, sf):
    i = F.col("doc_id")
    return tab(spark, sf, "documents").select("doc_id", ledger.project_state(i % 11 == 0, i % 5 == 0, F.when(i % 3 == 0, 1).otherwise(0), i % 4 == 0, i % 7).alias("state"))


# --- page pairs ---

_PAIRS = """pairs AS (SELECT page_id AS page, 420.0 AS sw, 300.0 AS sh, 420.0 + page_id % 5 * 0.5 AS tw, 300.0 AS th, CASE WHEN page_id % 6 = 0 THEN '' ELSE url END AS s_text, CASE WHEN page_id % 4 = 0 THEN ' ' WHEN page_id % 9 = 0 THEN url || '�' ELSE url END AS t_text,
  page_id % 3 AS s_images, page_id % 2 AS t_images, CASE WHEN page_id % 10 = 0 THEN 1 ELSE 0 END AS missing_images, page_id % 8 AS fonts, page_id % 13 = 0 AS notdef, CASE WHEN page_id % 12 = 0 THEN 2 ELSE 0 END AS outside, CASE WHEN page_id % 14 = 0 THEN 3 ELSE 0 END AS crossing,
  page_id % 7 / 20.0 AS s_ink, page_id % 11 / 40.0 AS t_ink, page_id % 15 > 0 AS raster_ok FROM pages)"""
_GATE = [
    ("greatest(abs(sw - tw), abs(sh - th)) > 1.0", "PAGE_GEOMETRY", "BLOCKING"), ("missing_images > 0", "IMAGE_COVERAGE", "BLOCKING"), ("(trim(s_text) <> '' OR s_images > 0) AND NOT (trim(t_text) <> '' OR t_images > 0)", "BLANK_PAGE", "BLOCKING"),
    ("contains(t_text, '�')", "CORRUPT_GLYPH", "BLOCKING"), ("trim(t_text) <> '' AND fonts = 0", "FONT", "BLOCKING"), ("notdef", "FONT", "ERROR"), ("outside > 0", "OUT_OF_BOUNDS", "BLOCKING"), ("crossing > 0", "OVERLAP", "ERROR"), ("NOT raster_ok", "FILE_INTEGRITY", "BLOCKING"),
    ("raster_ok AND s_ink >= 0.0001 AND t_ink < 0.0001", "CONTENT_DENSITY", "BLOCKING"), ("raster_ok AND s_ink > 0 AND t_ink / s_ink < 0.15", "CONTENT_DENSITY", "ERROR"),
]
_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT page, '{c}' AS category, '{s}' AS severity FROM pairs WHERE {k}" for k, c, s in _GATE) + ")"


def _pairs(spark, sf) -> DataFrame:
    i = F.col("page_id")
    some = lambda c, n: F.when(c, n).otherwise(0)
    return tab(spark, sf, "pages").select(
        i.alias("page"), F.lit(420.0).alias("sw"), F.lit(300.0).alias("sh"), (420.0 + i % 5 * 0.5).alias("tw"), F.lit(300.0).alias("th"), F.when(i % 6 == 0, "").otherwise(F.col("url")).alias("s_text"),
        F.when(i % 4 == 0, " ").when(i % 9 == 0, F.concat("url", F.lit("�"))).otherwise(F.col("url")).alias("t_text"), (i % 3).alias("s_images"), (i % 2).alias("t_images"), some(i % 10 == 0, 1).alias("missing_images"), (i % 8).alias("fonts"), (i % 13 == 0).alias("notdef"),
        some(i % 12 == 0, 2).alias("outside"), some(i % 14 == 0, 3).alias("overlaps"), (i % 7 / 20).alias("s_ink"), (i % 11 / 40).alias("t_ink"), (i % 15 > 0).alias("raster_ok"),
    )


@query(f"WITH {_PAIRS}, {_FOUND} SELECT * FROM found")
def pl17_page_pairs(spark, sf):
    """Every page against a target with other measures, texts, images, fonts and ink."""
    return gates.page_findings(_pairs(spark, sf))


@query(f"WITH {_PAIRS}, {_FOUND} SELECT page, list(category || ' ' || severity ORDER BY category, severity) AS findings, 'BLOCK' AS verdict FROM found GROUP BY page")
def ag07_ag14_page_reports(spark, sf):
    r = gates.report(gates.page_findings(_pairs(spark, sf)), "page")
    return r.withColumn("findings", F.transform("findings", lambda f: F.concat_ws(" ", f["category"], f["severity"])))


@query(f"""WITH {_PAIRS}, {_FOUND}, b AS (SELECT page_id AS page, list_filter([CASE WHEN page_id % 6 = 0 THEN 'release' END, CASE WHEN page_id % 10 = 0 THEN 'project' END, CASE WHEN page_id % 15 = 0 THEN 'source' END], lambda x: x IS NOT NULL) AS unbound FROM pages)
SELECT b.page, unbound, count(category) FILTER (len(unbound) = 0) AS n_findings, CASE WHEN len(unbound) > 0 THEN NULL WHEN count(category) > 0 THEN 'BLOCK' ELSE 'PASS' END AS verdict FROM b LEFT JOIN found ON found.page = b.page GROUP BY b.page, unbound""")
def pl16_pr21_verified_artifacts(spark, sf):
    """The binding gate before the page loop: a report of another release, project or source is not verified at all."""
    i = F.col("page_id")
    text = lambda c, n: F.when(i % n == 0, F.lit("other")).otherwise(c.cast("string"))
    p = tab(spark, sf, "pages").select(i.alias("page"), *(i.cast("string").alias(c) for c in ("release", "project", "source")), text(i, 6).alias("said_release"), text(i, 10).alias("said_project"), text(i, 15).alias("said_source"))
    bound = p.select("page", gates.binding_problems("release", "project", "source").alias("unbound"))
    found = gates.page_findings(_pairs(spark, sf).join(bound.where("size(unbound) = 0"), "page", "left_semi")).groupBy("page").agg(F.count("*").alias("n"))
    out = bound.join(found, "page", "left").withColumn("n_findings", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("page", "unbound", "n_findings", F.when(F.size("unbound") == 0, F.when(F.col("n_findings") > 0, "BLOCK").otherwise("PASS")).alias("verdict"))


@query("""SELECT doc_id, list_filter([CASE WHEN doc_id % 6 = 0 THEN 'unit' END, CASE WHEN doc_id % 5 = 0 THEN 'coverage' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'slice' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 11 = 0 THEN 'rendering' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 13 = 0 THEN 'overlap' END], lambda x: x IS NOT NULL) AS problems FROM documents WHERE length(text) >= 40""")
def pr14_rendered_targets(spark, sf):
    """Targets with two applied directives, some of another unit, without one, or with stale, wrong or overlapping places."""
    i, t = F.col("doc_id"), F.col("text")
    key = lambda k: F.lit(k).alias("occurrence_key")
    cut = lambda s, n: F.substring(t, s + 1, n)
    s2 = F.when(i % 13 == 0, 3).otherwise(20)
    wrong = F.when(i % 11 == 0, F.concat(cut(s2, 6), F.lit("?"))).otherwise(cut(s2, 6))
    directives = F.array(F.struct(key("a"), cut(0, 5).alias("required")), F.struct(key("b"), wrong.alias("required")))
    first = F.struct(key("a"), F.lit(0).alias("s"), F.lit(5).alias("e"), F.when(i % 7 == 0, F.concat(cut(0, 5), F.lit("#"))).otherwise(cut(0, 5)).alias("rendered"))
    first = first.withField("rendered", F.when(i % 7 == 0, F.concat(cut(0, 5), F.lit("#"))).otherwise(cut(0, 5)))
    second = F.struct(key("b"), s2.alias("s"), (s2 + 6).alias("e"), cut(s2, 6).alias("rendered"))
    applied = F.when(i % 5 == 0, F.array(first)).otherwise(F.array(first, second))
    unit = F.when(i % 6 == 0, F.lit("other")).otherwise(F.lit("u"))
    d = tab(spark, sf, "documents").where("length(text) >= 40")
    return d.select("doc_id", constraints.target_binding_problems(F.lit("u"), unit, t, directives, applied).alias("problems"))


@query("""SELECT event_id, list_filter([CASE WHEN event_id % 4 = 0 THEN 'brief' END, CASE WHEN event_id % 5 = 0 THEN 'concepts' END, CASE WHEN event_id % 7 = 0 THEN 'risks' END], lambda x: x IS NOT NULL) AS problems FROM events""")
def pr22_analysis_shapes(spark, sf):
    """Model replies to an analysis: a brief that is blank, lists that are missing or no lists."""
    i = F.col("event_id")
    brief = F.when(i % 4 == 0, F.lit('" "')).otherwise(F.to_json(F.struct("event_type")).substr(F.lit(15), F.length(F.to_json(F.struct("event_type"))) - 15))
    concepts = F.when(i % 5 == 0, F.lit('"none"')).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    risks = F.when(i % 7 == 0, F.lit("")).otherwise(F.lit(',"risks":[]'))
    text = F.concat(F.lit('{"brief":'), brief, F.lit(',"concepts":'), concepts, risks, F.lit("}"))
    return tab(spark, sf, "events").select("event_id", constraints.analysis_problems(text).alias("problems"))


@query("""SELECT doc_id FROM documents WHERE doc_id % 8 = 0 OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def pr24_stale_plans(spark, sf):
    """Plans of one document each, rebuilt from what they were made of: some keys are forged, some inputs changed."""
    from ..functions import identity as ids

    d = tab(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("manifest"))
    key = lambda m: ids.digest("ledgerloom.plan/1", doc=F.col("doc_id").cast("string"), lang=F.col("lang"), manifest=m)
    toxic = tab(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("changed", F.lit(True))
    stored = d.withColumn("plan_key", F.when(F.col("doc_id") % 8 == 0, F.sha2(F.lit("forged"), 256)).otherwise(key(F.col("manifest"))))
    now = d.join(toxic, "doc_id", "left").withColumn("manifest", F.when(F.col("changed"), F.sha2("manifest", 256)).otherwise(F.col("manifest")))
    rebuilt = now.select("doc_id", key(F.col("manifest")).alias("plan_key"))
    return constraints.conflicts(stored.select("doc_id", "plan_key"), rebuilt, "doc_id", "plan_key")
