"""Queries for markers, quoted spans, evidence harvest and part lookups, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixture
from ..functions import identity as ids
from ..functions import markers
from ..sources import blobs, evidence, records
from ..streaming.folders import shared_folder
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


MARKED = Fixture("k bigint, t string, keys array<string>, want string, spans array<string>, problem string", [
    (1, "在⟪T:a⟫熵⟪/T:a⟫中", ["a"], "在熵中", ["a 1 2"], None), (2, "⟪T:b⟫热⟪/T:b⟫⟪T:a⟫熵⟪/T:a⟫", ["a", "b"], "热熵", ["a 1 2", "b 0 1"], None), (3, "⟪T:x⟫熵⟪/T:x⟫", ["a"], None, None, "unknown marker"),
    (4, "⟪T:a⟫⟪T:b⟫熵⟪/T:b⟫⟪/T:a⟫", ["a", "b"], None, None, "nested or repeated"), (5, "⟪T:a⟫熵", ["a"], None, None, "not closed"), (6, "熵⟪/T:a⟫", ["a"], None, None, "unbalanced"),
    (7, "⟪T:a⟫火⟪/T:a⟫", ["a"], None, None, "wrong rendering"), (8, "熵", ["a"], None, None, "missing marker"), (9, "plain", [], "plain", [], None), (10, "x ⟪T:", [], None, None, "leaked marker"),
])
RENDERING = {"a": "熵", "b": "热"}


@case(f"SELECT k, want AS text, spans, problem FROM {MARKED.sql}")
def sp05_decode_markers(spark, sf):
    required = F.map_from_arrays("keys", F.transform("keys", lambda k: F.when(k == "a", RENDERING["a"]).otherwise(RENDERING["b"])))
    d = MARKED.df(spark).select("k", markers.decode_marked(F.col("t"), required).alias("d"))
    return d.select("k", "d.text", F.transform("d.spans", lambda s: F.concat_ws(" ", s["key"], s["s"].cast("string"), s["e"].cast("string"))).alias("spans"), "d.problem")


@query("SELECT doc_id // 20 AS unit, sha256(doc_id::VARCHAR) AS occurrence_key, lang AS required_rendering, '⟪T:' || sha256(doc_id::VARCHAR) || '⟫' AS open_marker, '⟪/T:' || sha256(doc_id::VARCHAR) || '⟫' AS close_marker FROM documents JOIN labels USING (doc_id)")
def sp10_marker_contract(spark, sf):
    """Guidance of units of up to 20 labelled documents, projected to its four text fields."""
    d = records.read_table(spark, sf, "documents").join(records.read_table(spark, sf, "labels").select("doc_id"), "doc_id")
    g = d.groupBy(F.expr("doc_id div 20").alias("unit")).agg(F.collect_list(F.struct(F.sha2(F.col("doc_id").cast("string"), 256).alias("key"), F.col("lang").alias("rendering"), "doc_id")).alias("g"))
    out = g.select("unit", F.inline(markers.marker_contract(F.col("g"))))
    return out.select("unit", F.col("key").alias("occurrence_key"), F.col("rendering").alias("required_rendering"), F.col("open").alias("open_marker"), F.col("close").alias("close_marker"))


QUOTES = Fixture("k bigint, t string, q string, decl int, s int, e int, problem string", [
    (1, "the heat of the sun", "heat", 4, 4, 8, None), (2, "the heat of the sun", "heat", 99, 4, 8, None), (3, "the heat of the sun", "the", 12, 12, 15, None), (4, "the heat of the sun", "the", None, None, None, "absent or ambiguous"),
    (5, "abc", "zzz", 0, None, None, "absent or ambiguous"), (6, "abc", "  ", 0, None, None, None), (7, "é \U0001f600 b", "b", -1, 4, 5, None),
])


@case(f"SELECT k, s, e, problem FROM {QUOTES.sql}")
def sp06_sp04_quote_spans(spark, sf):
    q = QUOTES.df(spark).select("k", markers.quote_span(F.col("t"), F.col("q"), F.col("decl")).alias("x"))
    return q.select("k", "x.*")


@query("""WITH p AS (SELECT DISTINCT regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS term, url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages), f AS (SELECT * FROM (VALUES ('en', 'the'), ('en', 'qqq'), ('de', 'der'), ('fr', 'les')) v(term, form))
SELECT p.term, form, url FROM p JOIN f USING (term) WHERE strpos(lower(t), form) > 0 GROUP BY ALL""")
def se06_harvest(spark, sf):
    p = records.read_table(spark, sf, "pages").select(F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("term"), "url", F.regexp_replace("html", "<[^>]*>", " ").alias("page_text"))
    forms = spark.createDataFrame([("en", "the"), ("en", "qqq"), ("de", "der"), ("fr", "les")], "term string, form string")
    return evidence.harvest(p, forms).select("term", "form", "url")


@query("SELECT source AS source_key, count(DISTINCT (lang, n_chars)) AS n FROM documents GROUP BY source HAVING count(DISTINCT (lang, n_chars)) > 1")
def ag13_conflicting_sources(spark, sf):
    d = records.read_table(spark, sf, "documents").select(F.col("source").alias("source_key"), F.col("lang").alias("source_uri"), F.col("n_chars").alias("retrieved_on"))
    return evidence.conflicting_sources(d)


@query(f"WITH {LINES} SELECT doc_id, para::INT AS para, source_text FROM rec WHERE source = 'src3'")
def src01_load_part(spark, sf):
    return records.segment(records.load_part(records.read_table(spark, sf, "documents"), "source", "src3")).select("doc_id", "para", "source_text")


@query(f"WITH {LINES} SELECT para::INT AS para, source_text, disposition, reason FROM rec WHERE doc_id = 7")
def src01_manifest_part(spark, sf):
    """Every document becomes a part of the manifest, one JSON blob each; one part is looked up and decoded."""
    manifest = shared_folder(spark, "manifest")
    records.register(records.segment(records.read_table(spark, sf, "documents")), "doc_id").write.parquet(manifest)
    return records.load_document(spark.read.parquet(manifest), "7")


def _page_store(spark, sf):
    """A store of all pages whose digests do not begin with 1, where contents whose digests begin with 0 were changed later."""
    p = records.read_table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    store = shared_folder(spark, "objects")
    first = F.left(F.sha2("content", 256), F.lit(1))
    blobs.put(p.where(~first.isin("0", "1")), store)
    bad = blobs.addressed(p.where(first == "0")).withColumn("content", F.concat("content", F.lit(b"x")))
    bad.write.mode("append").partitionBy("prefix").parquet(store)
    return p, store


@query("SELECT page_id, sha256(html) AS sha256, strlen(html) AS size, CASE left(sha256(html), 1) WHEN '0' THEN 'corrupt' WHEN '1' THEN 'missing' ELSE 'intact' END AS state FROM pages")
def src02_src16_src17_verified(spark, sf):
    """References to pages, looked up in a store that lacks some and holds some with other bytes."""
    p, store = _page_store(spark, sf)
    refs = p.select("page_id", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size"))
    return blobs.lookup(spark, refs, store).select("page_id", "sha256", "size", "state")


@query("""SELECT CASE WHEN page_id % 9 = 0 THEN 'k' ELSE 'c' END || page_id AS context_key, list_filter([CASE WHEN page_id % 9 = 0 THEN 'context' END, CASE WHEN page_id % 10 = 0 THEN 'project' END, CASE WHEN page_id % 7 = 0 THEN 'part' END,
  CASE WHEN left(sha256(html), 1) IN ('0', '1') THEN 'artifact' END], lambda x: x IS NOT NULL) AS problems FROM pages""")
def src13_context_bindings(spark, sf):
    """Context rows whose payload names another context, project or part, or whose artifact is not in the store."""
    p, store = _page_store(spark, sf)
    i = F.col("page_id")
    text = lambda c: c.cast("string")
    payload = F.to_json(F.struct(F.concat(F.lit("c"), text(i)).alias("context_key"), F.when(i % 10 == 0, "other").otherwise("project").alias("project_key"), F.when(i % 7 == 0, "x").otherwise(text(i % 3)).alias("part_key")))
    c = p.select(F.concat(F.when(i % 9 == 0, "k").otherwise("c"), text(i)).alias("context_key"), F.lit("project").alias("project_key"), text(i % 3).alias("part_key"), payload.alias("payload"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("size"))
    return blobs.context_problems(c, blobs.lookup(spark, c.select("sha256", "size"), store))


@query("SELECT sha256(html) AS sha256, strlen(any_value(html)) AS size, 'objects/' || left(sha256(html), 2) || '/' || sha256(html) || '.pdf' AS relative_path FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels) GROUP BY sha256(html)")
def src04_final_store(spark, sf):
    """The store of final artifacts, with a root and a suffix of its own; written twice, it holds each once."""
    p = records.read_table(spark, sf, "pages").join(records.read_table(spark, sf, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_anti").select(F.col("html").cast("binary").alias("content"))
    store = shared_folder(spark, "final")
    blobs.put(p, store, suffix=".pdf")
    blobs.put(p, store, suffix=".pdf")
    return blobs.get(spark, store).where("intact").select("sha256", "size", "relative_path")


_TRUE_KEY = "sha256('{\"namespace\":\"ledgerloom.record/1\",\"payload\":{\"doc\":\"' || doc_id || '\",\"para\":' || para || ',\"snapshot\":\"snapshot-1\"}}')"


@query(f"""WITH {LINES}, s AS (SELECT doc_id, para, CASE WHEN (doc_id + para) % 50 = 0 THEN sha256('forged') ELSE {_TRUE_KEY} END AS k, {_TRUE_KEY} AS t, source_text FROM rec)
SELECT doc_id, para::INT AS para, list_filter([CASE WHEN k <> t THEN 'key' END, CASE WHEN (doc_id + para) % 70 = 0 AND source_text <> 'changed' THEN 'revision' END], lambda x: x IS NOT NULL) AS wrong FROM s
WHERE k <> t OR ((doc_id + para) % 70 = 0 AND source_text <> 'changed')""")
def src11_divergent_records(spark, sf):
    """Layout records with the keys they came with; some keys are forged, some texts changed after their revision."""
    r = records.identify(records.segment(records.read_table(spark, sf, "documents")))
    at = F.col("doc_id") + F.col("para")
    r = r.withColumn("record_key", F.when(at % 50 == 0, F.sha2(F.lit("forged"), 256)).otherwise(F.col("record_key")))
    return records.divergent(r.withColumn("source_text", F.when(at % 70 == 0, "changed").otherwise(F.col("source_text"))))


@query(r"""WITH RECURSIVE mv AS (SELECT a.url, min(b.url) AS l FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.page_id % 4 <> 0 GROUP BY a.url),
h AS (SELECT url, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, regexp_matches(url, '^https?://[^\s/?#@]+([/?#]|$)') AS f FROM (SELECT DISTINCT url FROM pages)),
ok AS (SELECT url, f AND length(host) % 5 <> 0 AS ok FROM h),
w AS (SELECT url, url AS now, 0 AS n, false AS ended FROM ok UNION ALL
  SELECT w.url, CASE WHEN NOT ok.ok THEN NULL ELSE coalesce(mv.l, w.now) END, n + 1, NOT ok.ok OR mv.l IS NULL FROM w JOIN ok ON ok.url = w.now LEFT JOIN mv ON mv.url = w.now WHERE NOT w.ended AND n < 4)
SELECT url, CASE WHEN ended THEN now END AS final_url, CASE WHEN ended AND now IS NOT NULL THEN true ELSE false END AS found FROM (SELECT url, arg_max(now, n) AS n0, arg_max(struct_pack(now := now), n).now AS now, arg_max(ended, n) AS ended FROM w GROUP BY url)""")
def src07_resolved_pages(spark, sf):
    """Pages that lead to the next one, but for every fourth; some hosts have a private address."""
    p = records.read_table(spark, sf, "pages").select("page_id", "url", "html")
    moved = p.where("page_id % 4 <> 0").select(F.col("url").alias("from"), (F.col("page_id") + 1).alias("page_id")).join(p, "page_id").groupBy(F.col("from").alias("url")).agg(F.min("url").alias("location"))
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    a = p.select(host.alias("host")).distinct().withColumn("address", F.when(F.length("host") % 5 == 0, "10.1.2.3").otherwise("8.8.8.8"))
    a = a.unionByName(a.withColumn("address", F.lit("2606:4700::1111")))
    r = evidence.resolve(p, moved, a, p)
    return r.select("url", "final_url", F.col("page_text").isNotNull().alias("found"))


@query("""SELECT doc_id, sha256('{"namespace":"ledgerloom.brief/1","payload":{"origin":"' || source || '","text":"' || lang || ' brief"}}') AS brief_id FROM documents""")
def pl20_briefs(spark, sf):
    return records.read_table(spark, sf, "documents").select("doc_id", ids.digest(ids.NS_BRIEF, text=F.concat("lang", F.lit(" brief")), origin=F.col("source")).alias("brief_id"))
