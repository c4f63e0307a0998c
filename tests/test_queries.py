"""Every registered query of the core against its SQL."""

import pytest

from ledgerloom.plans import catalog
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(catalog.CASES))
def test_rule_on_typed_cases(spark, con, name):
    same(catalog.CASES[name](spark, SF), con, catalog.CASE_SQL[name])


def test_every_query_has_sql_and_reads_a_table():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and not set(catalog.CASES) & set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name, table", [
    ("fn01_normalized_documents", "documents"), ("fn06_event_values", "events"), ("fn07_fn08_document_tags", "documents"), ("fn11_document_fragments", "documents"), ("fn12_document_anchors", "documents"),
    ("fn15_fn16_page_authority", "pages"), ("fn21_fn22_fn23_documents", "documents"), ("fn26_event_settings", "events"),
])
def test_text_functions_read_every_row(spark, name, table):
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert name in catalog.ORACLES and catalog.QUERIES[name](spark, SF).count() == rows


def test_text_functions_find_something_in_the_tables(spark):
    found = catalog.QUERIES["fn12_document_anchors"](spark, SF)
    assert found.where("size(anchors) > 0").count() > 0
    red = catalog.QUERIES["fn21_fn22_fn23_documents"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id")
    assert red.where("red = text AND length(text) > 2000").count() > 0
    assert catalog.QUERIES["jn09_so06_document_anchors"](spark, SF).count() > 0


def test_anchor_sql_on_the_fixture(con):
    from ledgerloom.plans.text_queries import ANCHORS, _anchors_sql

    assert con.execute(f"SELECT k FROM {ANCHORS.sql} WHERE {_anchors_sql('t')} <> want").fetchall() == []


def test_service_replies_are_whole_texts(spark):
    replies = catalog.QUERIES["ud01_ud02_ud03_whole_replies"](spark, SF)
    texts = spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("conv_id * 100 + turn AS call", "text AS reply")
    assert replies.exceptAll(texts).isEmpty() and replies.count() == texts.count() and texts.where("length(reply) > 20").count() > 0


def odd(spark, folder, table, rows, schema):
    """A folder of tables as in ``SF``, one of which has other rows."""
    import os

    for t in os.listdir(SF):
        if t != f"{table}.parquet":
            os.symlink(f"{SF}/{t}", f"{folder}/{t}")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_excerpts_keep_line_ends_at_their_edge(spark, tmp_path):
    texts = ["before all that there was the end of this page.\nA line", "a\nbcdefghijklmnopqrs the end", "  the  ", "\n", " ", "", None, "\tThe\t", "no hit"]
    folder = odd(spark, tmp_path, "benchmark", list(enumerate(texts)), "item_id long, text string")
    same(catalog.QUERIES["fn13_fn14_excerpt"](spark, folder), connect(folder), catalog.ORACLES["fn13_fn14_excerpt"])


def test_references_without_semicolon_stay_but_at_the_end_of_a_page(spark, tmp_path):
    pages = ["<title>a &amp;&amp</title><p>b&amp c &ampd &copy &copy; &quot;x&quot y</p>", "<p>a &amp;amp; b</p> c&amp", "c&amp\n", "<p>a&amp;quot;b &middot; &middot</p>", "", None]
    folder = odd(spark, tmp_path, "pages", [(i, "https://a.example/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    same(catalog.QUERIES["src08_visible_text"](spark, folder), connect(folder), catalog.ORACLES["src08_visible_text"])


def test_equal_boxes_overlap_as_often_as_they_are_there(spark):
    from itertools import combinations

    from pyspark.sql import functions as F

    from ledgerloom.operators import gates

    schema = "page long, block long, line long, x0 double, y0 double, x1 double, y1 double"
    rows = [(i % 2 if i % 11 else None, i % 3 if i % 13 else None, i // 2, float(i % 5 * 30), float(i % 4 * 20), float(i % 5 * 30 + 70), float(i % 4 * 20 + 50)) for i in range(400)]
    rows += rows[:90] + [(0, 1, 999, None, 0.0, 9.0, 9.0), (0, 2, 999, -40.0, -20.0, 3.0, 3.0)]
    want = {}
    for a, b in combinations([r for r in rows if None not in r], 2):
        w, h = (min(a[k + 2], b[k + 2]) - max(a[k], b[k]) for k in (3, 4))
        small = min((r[5] - r[3]) * (r[6] - r[4]) for r in (a, b))
        if a[0] == b[0] and a[1] != b[1] and w > 0 and h > 0 and w * h > 0.55 * small:
            want[a[0]] = want.get(a[0], 0) + 1
    assert {r.page: r.overlaps for r in gates.overlapping_lines(spark.createDataFrame(rows, schema)).collect()} == want and len(want) == 2
    # Forty billion pairs of two boxes with their copies: counted, not looked at one by one.
    i = F.col("id")
    box = (F.lit(float(x)).alias(c) for c, x in zip(("x0", "y0", "x1", "y1"), (0, 0, 300, 200), strict=True))
    copies = spark.range(400_000).select(F.lit(1).cast("long").alias("page"), (i % 2).alias("block"), i.alias("line"), *box)
    assert [tuple(r) for r in gates.overlapping_lines(copies).collect()] == [(1, 200_000**2)]
