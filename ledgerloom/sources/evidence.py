"""Evidence rows: JSON catalog source, row constraints, visible text of pages, citations."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import is_sha256
from ..functions.text import normalize_text, strip

ENTRY = (
    "source_term string, sense_id string, target_form string, stance string, kind string, tier string, source_key string, source_uri string, "
    "source_title string, excerpt string, retrieved_on string, sense_match boolean, domain_match boolean, notes string"
)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON files ``{"entries": [...]}``; malformed files fail the read."""
    files = spark.read.schema(f"entries array<struct<{ENTRY.replace(' string', ': string').replace(' boolean', ': boolean')}>>")
    return files.option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("entries"))


def problems(target: str = "target_form", excerpt: str = "excerpt", key: str = "source_key", uri: str = "source_uri", day: str = "retrieved_on") -> Column:
    """Names of the constraints that a row breaks, in order; empty for a valid row."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    rules = [
        (blank(target) | blank(excerpt), "blank text"),
        (~is_sha256(F.col(key)), "source key"),
        (~F.coalesce(F.col(uri).rlike(r"^(https?://[^\s/?#]+|urn:\S+)"), F.lit(False)), "uri"),
        (~F.coalesce(F.col(day).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.col(day), "yyyy-MM-dd").isNotNull(), F.lit(False)), "date"),
        (~F.coalesce(F.contains(F.lower(excerpt), F.lower(target)), F.lit(False)), "excerpt lacks target"),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in rules)), lambda x: x.isNotNull())


def catalog(entries: DataFrame) -> DataFrame:
    """Distinct entries by their six identifying fields."""
    return entries.dropDuplicates(["source_term", "sense_id", "target_form", "stance", "source_key", "excerpt"])


def conflicting_sources(entries: DataFrame) -> DataFrame:
    """Source keys that stand for more than one (uri, date): a broken functional dependency."""
    return entries.groupBy("source_key").agg(F.count_distinct("source_uri", "retrieved_on").alias("n")).where("n > 1")


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "svg")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "svg") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def _visible_text(pages: pd.Series) -> pd.Series:
    def one(page: str | None) -> str | None:
        if page is None:
            return None
        parser = _Visible()
        parser.feed(page)
        parser.close()
        return " ".join(" ".join(parser.parts).split())

    return pages.map(one)


def visible_text(html: Column) -> Column:
    """All text outside scripts, styles, noscript and svg, white space collapsed, NFC."""
    return normalize_text(_visible_text(html))


def fetchable(url: Column) -> Column:
    """Whether a page address may be fetched: http(s), no credentials, port 80 or 443 or none."""
    port = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    return F.coalesce(url.rlike(r"(?i)^https?://[^\s/?#@]+([/?#]|$)") & port.isin("", "80", "443"), F.lit(False))


def harvest(citations: DataFrame, forms: DataFrame, radius: int = 180) -> DataFrame:
    """Citations of each concept joined with its candidate forms where the page text holds the form.

    ``citations``: term, url, page_text; ``forms``: term, form.  An equi-join on the term, so no
    cross product; one row per (term, form, url).
    """
    from ..functions.text import excerpt

    return (
        citations.join(forms, "term")
        .withColumn("excerpt", excerpt(F.col("page_text"), F.col("form"), radius))
        .where(F.col("excerpt").isNotNull())
        .dropDuplicates(["term", "form", "url"])
        .select("term", "form", "url", "excerpt")
    )


def fetch(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """The visible text of each cited page that may be fetched and is in ``pages``; null otherwise.

    The page table takes the place of a live fetcher.
    """
    held = pages.groupBy("url").agg(F.max("html").alias("html"))
    allowed = F.when(fetchable(F.col("url")), F.col("html"))
    return citations.join(held, "url", "left").withColumn("page_text", visible_text(allowed)).drop("html")


#: Pages are read up to so many bytes; longer ones are refused.
LARGEST_PAGE = 2_000_000


def resolve(urls: DataFrame, redirects: DataFrame, addresses: DataFrame, pages: DataFrame, hops: int = 4) -> DataFrame:
    """``url, final_url, page_text`` of pages reached by at most ``hops`` requests; null text where any step is refused.

    ``redirects``: ``url, location``; ``addresses``: ``host, address`` (all of a host's must be public);
    ``pages``: ``url, html``.  Every step must be an address that may be fetched.  The tables take the
    place of the network.
    """
    from ..functions.values import globally_routable, host

    public = addresses.groupBy("host").agg(F.bool_and(globally_routable(F.col("address"))).alias("public"))
    moved = redirects.groupBy("url").agg(F.max("location").alias("location")).withColumnRenamed("url", "now")
    step = urls.select("url").distinct().withColumns({"now": F.col("url"), "ended": F.lit(False)})
    for _ in range(hops):
        open_ = step.where("NOT ended").withColumn("host", host(F.col("now"))).join(public, "host", "left")
        allowed = fetchable(F.col("now")) & F.coalesce("public", F.lit(False))
        went = open_.withColumn("ok", allowed).join(moved, "now", "left")
        went = went.select("url", F.when(~F.col("ok"), None).otherwise(F.coalesce("location", "now")).alias("now"), (~F.col("ok") | F.col("location").isNull()).alias("ended"))
        step = step.where("ended").unionByName(went)
    final = step.select("url", F.when(F.col("ended"), F.col("now")).alias("final_url"))
    held = pages.where(F.octet_length("html") <= LARGEST_PAGE).groupBy(F.col("url").alias("final_url")).agg(F.max("html").alias("html"))
    return final.join(held, "final_url", "left").select("url", "final_url", visible_text(F.col("html")).alias("page_text"))
