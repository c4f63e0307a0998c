"""Row and set constraints.  Row rules give an array of broken rules (empty: valid); set rules give
the offending rows (none: valid), so nothing is collected to decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from ..functions.values import SERIOUS
from ..sources.records import ALLOWED

SPEC = "array<struct<kind:string,open_token:string,close_token:string>>"


def broken(*rules: tuple[Column, str]) -> Column:
    """Names of the rules whose condition holds (null counts as not holding)."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in rules)), lambda x: x.isNotNull())


def tokens(specs: Column) -> Column:
    """All tokens of placeholder specs, in order."""
    return F.flatten(F.transform(specs, lambda s: F.filter(F.array(s["open_token"], s["close_token"]), lambda t: t.isNotNull())))


def contract_problems(namespace: Column, specs: Column) -> Column:
    """Shape of a placeholder contract: namespace, unique tokens, tokens that fit their kind."""
    own = tokens(specs)
    name = r"^PT2-[0-9a-f]{12}$"

    def ok(s: Column) -> Column:
        inner = lambda tail: F.concat(F.lit(r"^\[\["), namespace, F.lit(tail))
        formula = s["close_token"].isNull() & F.regexp_like(s["open_token"], inner(r":F:\d{4,}\]\]$"))
        number = lambda t: F.regexp_extract(t, r":S:(\d{4,}):", 1)
        style = F.regexp_like(s["open_token"], inner(r":S:\d{4,}:OPEN\]\]$")) & F.regexp_like(s["close_token"], inner(r":S:\d{4,}:CLOSE\]\]$")) & (number(s["open_token"]) == number(s["close_token"]))
        return F.coalesce(F.when(s["kind"] == "formula", formula).when(s["kind"] == "rich_style", style), F.lit(False))

    return broken((~namespace.rlike(name), "namespace"), (F.size(own) != F.size(F.array_distinct(own)), "tokens repeat"), (~F.forall(specs, ok), "token shape"))


def _count(text: Column, token: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("int")


def placeholder_problems(text: Column, namespace: Column, specs: Column) -> Column:
    """Damage of protected tokens in a text: lost, repeated, invented, unterminated, reordered, empty style."""
    own = tokens(specs)
    prefix = F.concat(F.lit("[["), namespace, F.lit(":"))
    found = F.regexp_extract_all(text, F.concat(F.lit(r"\Q[["), namespace, F.lit(r":\E(?s:.*?)\]\]")), F.lit(0))
    places = F.filter(F.transform(own, lambda t: F.instr(text, t)), lambda p: p > 0)
    empty_style = F.exists(
        F.filter(specs, lambda s: s["kind"] == "rich_style"),
        lambda s: (F.instr(text, s["open_token"]) > 0) & (F.instr(text, s["close_token"]) > 0) & (
            (F.instr(text, s["close_token"]) < F.instr(text, s["open_token"]) + F.length(s["open_token"]))
            | (strip(F.substring(text, F.instr(text, s["open_token"]) + F.length(s["open_token"]), F.instr(text, s["close_token"]) - F.instr(text, s["open_token"]) - F.length(s["open_token"]))) == "")
        ),
    )
    return broken(
        (F.exists(own, lambda t: _count(text, t) != 1), "count"),
        (_count(text, prefix) > F.size(found), "unterminated"),
        (F.array_sort(found) != F.array_sort(own), "invented"),
        (places != F.array_sort(places), "order"),
        (empty_style, "empty style"),
    )


def record_problems(disposition: Column, reason: Column, has_unit: Column, has_box: Column, vertical: Column) -> Column:
    """Disposition and reason must fit; units only on translatable records; boxes except where missing."""
    pair = F.lit(False)
    for d, reasons in ALLOWED.items():
        pair = pair | ((disposition == d) & reason.isin(*reasons))
    return broken(
        (~pair, "reason"),
        ((disposition == "translatable") != has_unit, "unit"),
        ((reason == "MISSING_GEOMETRY") == has_box, "box"),
        ((reason == "VERTICAL_TEXT_UNSUPPORTED") & ~vertical, "vertical"),
    )


def blocked(records: DataFrame, key: str) -> DataFrame:
    """Keys with any blocker record."""
    return records.groupBy(key).agg(F.count_if(F.col("disposition") == "blocker").alias("blockers")).where("blockers > 0")


def exact_cover(expected: DataFrame, actual: DataFrame, key: str, revision: str) -> DataFrame:
    """Rows ``key, problem`` unless ``actual`` holds each expected key once with its revision."""
    a = actual.groupBy(key).agg(F.count("*").alias("n"), F.max(revision).alias("got"))
    both = expected.select(key, F.col(revision).alias("want")).join(a, key, "full_outer")
    problem = (
        F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("n") > 1, "duplicate").when(F.col("got") != F.col("want"), "stale")
    )
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def target_problems(text: Column) -> Column:
    return broken((blank(text), "blank"), (text.rlike(r"[\p{Cc}&&[^\n\t]]"), "control character"))


def route_problems(level: Column, lanes: Column, reasons: Column) -> Column:
    n = F.size(lanes)
    return broken(
        (~n.between(1, 3), "lane count"), (n != F.size(F.array_distinct(lanes)), "lanes repeat"), ((level == "R1") & (n != 1), "R1 lanes"),
        ((level == "R3") & (n < 2), "R3 lanes"), ((level != "R1") & (F.size(reasons) == 0), "reasons"),
    )


def review_problems(options: Column, findings: Column, source: Column, citations: bool) -> Column:
    """Shape of a review: known options, each finding once, quotations at the places they name.

    ``options``: array of (option_key, target_text); ``findings``: array of (finding_id, option_key,
    severity, message, source_span, target_span), the spans being (s, e, quoted), 0-based and half-open,
    in the source and in the option's text.  With ``citations`` a serious finding needs one of them.
    """
    ids_ = F.transform(findings, lambda f: f["finding_id"])
    keys = F.transform(options, lambda o: o["option_key"])
    own = lambda f: F.try_element_at(F.filter(options, lambda o: o["option_key"] == f["option_key"]), F.lit(1))["target_text"]

    def misquoted(text: Column, span: Column) -> Column:
        return span.isNotNull() & (F.size(span_problems(text, span["s"], span["e"], span["quoted"])) > 0)

    uncited = lambda f: f["severity"].isin(*SERIOUS) & f["source_span"].isNull() & f["target_span"].isNull()
    return broken(
        (F.exists(findings, lambda f: ~F.array_contains(keys, F.coalesce(f["option_key"], F.lit("")))), "unknown option"),
        (F.size(ids_) != F.size(F.array_distinct(ids_)), "repeated finding"),
        (F.exists(findings, lambda f: misquoted(source, f["source_span"]) | misquoted(own(f), f["target_span"])), "citation"),
        (F.exists(findings, uncited) if citations else F.lit(False), "uncited"),
    )


def directive_problems(text: Column, directives: Column) -> Column:
    """Whether a text holds every rendering that its directives demand, as often as they do.

    ``directives``: array of (occurrence_key, source_term, required, treatment).
    """
    required = F.transform(directives, lambda d: d["required"])
    lacks = lambda r: _count(text, r) < F.size(F.filter(required, lambda x: x == r))
    return broken((F.exists(F.array_distinct(required), lacks), "rendering"))


def span_problems(text: Column, start: Column, end: Column, quoted: Column) -> Column:
    """0-based half-open code-point span that must quote its text and not be blank."""
    inside = (start >= 0) & (start < end) & (end <= F.length(text))
    cut = F.substring(text, start + 1, end - start)
    return broken((~F.coalesce(inside, F.lit(False)), "bounds"), (inside & (cut != quoted), "slice"), (inside & (strip(cut) == ""), "blank"))


def overlapping(spans: DataFrame, key: str, start: str = "s", end: str = "e") -> DataFrame:
    """Spans that begin before an earlier one of the same key has ended (half-open)."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_upto", F.max(end).over(w)).where(F.col("_upto") > F.col(start)).drop("_upto")


def adjudication_problems(mode: Column, selected: Column, findings: Column, resolutions: Column) -> Column:
    """Legality of an adjudication.

    ``findings``: array of (finding_id, option_key, severity); ``resolutions``: array of (finding_id, action).
    """
    serious = F.filter(findings, lambda f: f["severity"].isin(*SERIOUS))
    known = F.transform(findings, lambda f: f["finding_id"])
    resolved = F.transform(resolutions, lambda r: r["finding_id"])
    action = lambda f: F.try_element_at(F.filter(resolutions, lambda r: r["finding_id"] == f["finding_id"]), F.lit(1))["action"]
    own = lambda f: F.coalesce(f["option_key"] == selected, F.lit(False))
    select = mode == "SELECT"
    return broken(
        (select & selected.isNull(), "no selection"),
        (~select & selected.isNotNull(), "synthesis selects"),
        (F.size(F.array_except(resolved, known)) > 0, "unknown finding"),
        (F.exists(serious, lambda f: action(f).isNull()), "unresolved"),
        (select & F.exists(serious, lambda f: ~own(f) & ~action(f).isin("AVOIDED", "FALSE_POSITIVE")), "other option"),
        (select & F.exists(serious, lambda f: own(f) & ~action(f).isin("FALSE_POSITIVE", "PRESERVED_SOURCE_AMBIGUITY")), "own text"),
        (select & F.exists(serious, lambda f: own(f) & f["severity"].isin("CRITICAL", "BLOCKING") & (action(f) != "FALSE_POSITIVE")), "critical stays"),
        (~select & F.exists(serious, lambda f: action(f) == "AVOIDED"), "synthesis avoids"),
    )


def verdict_problems(verdict: Column, serious: Column, impact: Column, changed: Column) -> Column:
    """PASS if and only if nothing is serious and nothing degrades; unchanged text is equivalent."""
    clean = ~serious & (impact != "DEGRADES")
    return broken((~changed & (impact != "EQUIVALENT"), "unchanged"), ((verdict == "PASS") != clean, "verdict"))


def decision_problems(confidence: Column, researcher: Column, reviewer: Column, sources: Column, strong: Column, contradicted: Column, conventionality: Column, fit: Column, best: Column, override: Column, form: Column, term: Column) -> Column:
    """Evidence thresholds of a term decision; ``best``: rank of the most conventional confirmed form."""
    from ..functions.values import CONVENTIONALITY, rank_of

    kept = confidence == "RETAINED_UNRESOLVED"
    return broken(
        (researcher == reviewer, "same actor"),
        (~kept & (fit != "CONFIRMED"), "fit"),
        ((confidence == "VERIFIED") & ((sources < 2) | (strong < 1) | contradicted), "verified evidence"),
        ((confidence == "VERIFIED") & ~conventionality.isin("ESTABLISHED", "ATTESTED"), "verified form"),
        ((confidence == "SUPPORTED") & ((sources < 1) | ((strong < 1) & (sources < 2)) | contradicted), "supported evidence"),
        ((confidence == "PROVISIONAL") & (sources < 1), "no attestation"),
        (kept & (form != term), "not retained"),
        (~kept & (best > rank_of(conventionality, CONVENTIONALITY)) & (F.coalesce(strip(override), F.lit("")) == ""), "mainstream"),
    )


def treatment_problems(treatment: Column, confidence: Column) -> Column:
    """Only verified terms stand alone; unresolved ones are kept in the source language."""
    return broken(
        ((treatment == "TRANSLATE_ONLY") & (confidence != "VERIFIED"), "needs source"),
        ((confidence == "RETAINED_UNRESOLVED") != (treatment == "RETAIN_SOURCE"), "retention"),
    )


def conflicts(stored: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys whose incoming payload differs from the stored one."""
    return stored.select(key, F.col(payload).alias("_old")).join(incoming, key).where(~F.col("_old").eqNullSafe(F.col(payload))).select(key)


def unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side holds more often than the other (bag semantics)."""
    return left.exceptAll(right).unionByName(right.exceptAll(left))


def plan_problems(routes: DataFrame, units: DataFrame, lanes: DataFrame, actors: DataFrame) -> DataFrame:
    """Problems of a plan as rows: uncovered units, stale revisions, unknown lanes, shared actors."""
    cover = exact_cover(units, routes, "unit_key", "unit_revision").select(F.col("problem"), F.col("unit_key").cast("string").alias("subject"))
    used = routes.select(F.explode("lane_keys").alias("lane_key")).distinct()
    unknown = used.join(lanes, "lane_key", "left_anti").select(F.lit("unknown lane").alias("problem"), F.col("lane_key").alias("subject"))
    both = actors.groupBy("actor_key").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    shared = both.where(F.arrays_overlap("roles", F.array(F.lit("TRANSLATOR"))) & F.arrays_overlap("roles", F.array(F.lit("BILINGUAL_REVIEWER")))).select(F.lit("shared actor").alias("problem"), F.col("actor_key").alias("subject"))
    return cover.unionByName(unknown).unionByName(shared)


def cast_problems(lanes: DataFrame, actors: DataFrame) -> DataFrame:
    """Problems of who does what, as rows: repeated lanes, actors that have a role twice, lanes whose actor (``actor_key``) is no translator."""
    again = lambda df, keys, name: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("problem"), F.col(keys[0]).cast("string").alias("subject")).distinct()
    able = actors.where("role = 'TRANSLATOR'").select("actor_key")
    alone = lanes.join(able, "actor_key", "left_anti").select(F.lit("lane without translator").alias("problem"), F.col("lane_key").cast("string").alias("subject")).distinct()
    return again(lanes, ["lane_key"], "repeated lane").unionByName(again(actors, ["actor_key", "role"], "repeated actor")).unionByName(alone)


def occurrence_problems(occurrences: Column) -> Column:
    """Occurrences of one term revision, array of (term, at): one term, in order, no place twice."""
    places, names = F.transform(occurrences, lambda o: o["at"]), F.transform(occurrences, lambda o: o["term"])
    return broken(
        (F.size(F.array_distinct(names)) > 1, "other term"), (F.size(F.array_distinct(places)) < F.size(places), "repeated"), (F.array_sort(places) != places, "order")
    )


def document_verdict_problems(verdict: Column, serious: Column, said_set: Column, outcome_set: Column, cited: Column, known: Column) -> Column:
    """A document's verdict is about the outcomes it names and no other units, and follows from its findings."""
    return broken(
        (~said_set.eqNullSafe(outcome_set), "outcome set"), (F.size(F.array_except(cited, known)) > 0, "unknown unit"), ((verdict == "PASS") == serious, "verdict")
    )


def target_binding_problems(unit: Column, said_unit: Column, text: Column, directives: Column, applications: Column) -> Column:
    """Whether a rendered target belongs to its unit and applies exactly the directives it must.

    ``directives``: array of (occurrence_key, required); ``applications``: array of (occurrence_key,
    s, e, rendered), the places being 0-based and half-open.
    """
    wanted, got = F.transform(directives, lambda d: d["occurrence_key"]), F.transform(applications, lambda a: a["occurrence_key"])
    covered = (F.size(got) == F.size(F.array_distinct(got))) & (F.array_sort(wanted) == F.array_sort(got))
    required = lambda a: F.filter(directives, lambda d: d["occurrence_key"] == a["occurrence_key"])[0]["required"]
    stale = F.exists(applications, lambda a: (a["e"] > F.length(text)) | (F.substring(text, a["s"] + 1, a["e"] - a["s"]) != a["rendered"]))
    wrong = F.exists(applications, lambda a: F.substring(text, a["s"] + 1, a["e"] - a["s"]) != required(a))
    clash = F.exists(applications, lambda a: F.exists(applications, lambda b: (a["occurrence_key"] != b["occurrence_key"]) & (a["s"] < b["e"]) & (b["s"] < a["e"])))
    return broken((unit != said_unit, "unit"), (~covered, "coverage"), (covered & stale, "slice"), (covered & wrong, "rendering"), (covered & clash, "overlap"))


def analysis_problems(reply: Column) -> Column:
    """Shape of an analysis: a brief that is not blank, and lists of concepts and risks."""
    d = F.from_json(reply, "struct<brief:string,concepts:string,risks:string>")
    is_list = lambda c: F.coalesce(F.startswith(F.trim(c), F.lit("[")), F.lit(False))
    return broken((F.coalesce(strip(d["brief"]), F.lit("")) == "", "brief"), (~is_list(d["concepts"]), "concepts"), (~is_list(d["risks"]), "risks"))
