"""Rules over what the tables hold: priorities, suppliers, dates, amounts and texts are the rules' inputs, ids only name rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as vl
from ..operators import constraints, gates
from ..sources import records
from .text_queries import LINES, docs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def tab(spark, sf, name) -> DataFrame:
    return records.read_table(spark, sf, name)


_PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, (nullif(list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority), 0) - 1)::INT AS rank, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'O' END AS status,
  least(30.0, greatest(pow(2.0, greatest(0, coalesce(n, 0) - 1)), coalesce(o_totalprice / 20000, 0)))::DOUBLE AS delay FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def fn19_fn27_fn31_order_ranks(spark, sf):
    """Orders: the rank of their priority, their status or O, and a wait after as many attempts as they have lines, by the hint of their price."""
    n = tab(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = tab(spark, sf, "orders").join(n, "o_orderkey", "left")
    return o.select("o_orderkey", vl.rank_of(F.col("o_orderpriority"), _PRIORITIES).alias("rank"), vl.enum_or(F.col("o_orderstatus"), ("O", "F"), "O").alias("status"), vl.retry_delay(F.coalesce("n", F.lit(0)), F.col("o_totalprice") / 20000).alias("delay"))


_PROBLEMS = "list_filter([{}], lambda x: x IS NOT NULL)"


@query(f"""WITH l AS (SELECT l_orderkey, list(l_suppkey) AS lanes, list(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') AS reasons FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'R3' WHEN '5-LOW' THEN 'R1' ELSE 'R2' END AS level, coalesce(len(lanes), 0) AS n, coalesce(len(list_distinct(lanes)), 0) AS k, coalesce(len(reasons), 0) AS why FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, {_PROBLEMS.format("CASE WHEN n NOT BETWEEN 1 AND 3 THEN 'lane count' END, CASE WHEN n <> k THEN 'lanes repeat' END, CASE WHEN level = 'R1' AND n <> 1 THEN 'R1 lanes' END, CASE WHEN level = 'R3' AND n < 2 THEN 'R3 lanes' END, CASE WHEN level <> 'R1' AND why = 0 THEN 'reasons' END")} AS problems FROM r""")
def pr09_order_routes(spark, sf):
    """Orders as routes: their suppliers are the lanes, their priority the level, what was returned the reasons."""
    l = tab(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_suppkey").alias("lanes"), F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("reasons"))
    o = tab(spark, sf, "orders").join(l, "o_orderkey", "left")
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "R3").when(F.col("o_orderpriority") == "5-LOW", "R1").otherwise("R2")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    return o.select("o_orderkey", constraints.route_problems(level, none("lanes", "bigint"), none("reasons", "string")).alias("problems"))


@query("""WITH s AS (SELECT l_suppkey AS k, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE l_shipdate IS NOT NULL)
SELECT k, s, e FROM (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM s) WHERE u > s""")
def wn05_shipment_overlaps(spark, sf):
    """Shipments of a supplier that begin while an earlier one, of as many days as it has pieces, is under way."""
    s = F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long")
    spans = tab(spark, sf, "lineitem").where("l_shipdate IS NOT NULL").select(F.col("l_suppkey").alias("k"), s.alias("s"), (s + F.col("l_quantity").cast("long")).alias("e"))
    return constraints.overlapping(spans, "k")


_BOXES = "b AS (SELECT l_partkey AS page, l_suppkey AS block, l_orderkey * 8 + l_linenumber AS line, l_quantity * 4 AS x0, l_tax * 300 AS y0, l_quantity * 4 + 20 + l_discount * 100 AS x1, l_tax * 300 + 12 AS y1 FROM lineitem)"


def _boxes(spark, sf) -> DataFrame:
    q, t = F.col("l_quantity") * 4, F.col("l_tax") * 300
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line")
    return tab(spark, sf, "lineitem").select(F.col("l_partkey").alias("page"), F.col("l_suppkey").alias("block"), line, q.alias("x0"), t.alias("y0"), (q + 20 + F.col("l_discount") * 100).alias("x1"), (t + 12).alias("y1"))


@query(f"""WITH {_BOXES}, p AS (SELECT a.page, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS small FROM b a JOIN b ON a.page = b.page AND a.block < b.block)
SELECT page, count(*) AS overlaps FROM p WHERE w > 0 AND h > 0 AND w * h > 0.55 * small GROUP BY page""")
def jn10_part_boxes(spark, sf):
    """Parts as pages, suppliers as blocks, lines by quantity and tax: pairs of different blocks that overlap."""
    return gates.overlapping_lines(_boxes(spark, sf))


@query(f"""WITH {_BOXES}, n AS (SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY block) - 1 AS block, row_number() OVER (PARTITION BY page, block ORDER BY line, x0, y0, x1, y1) - 1 AS line, x0, y0, x0 + 30 - (x1 - x0) AS x1, y1 FROM b)
SELECT page, block::INT AS block, line::INT AS line, x0, y0, x1, y1 FROM n WHERE x1 > x0 AND y1 > y0""")
def sp08_sp09_part_lines(spark, sf):
    """The same pages nested into blocks and lines, of which the lines with large discounts have no width, and flattened again."""
    b = _boxes(spark, sf)
    rows = F.array_sort(F.collect_list(F.struct("line", "x0", "y0", "x1", "y1")))
    box = F.transform(rows, lambda r: F.struct(r["x0"].alias("x0"), r["y0"].alias("y0"), (r["x0"] + 30 - (r["x1"] - r["x0"])).alias("x1"), r["y1"].alias("y1")))
    per = b.groupBy("page", "block").agg(box.alias("lines"))
    nested = per.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "lines"))), lambda r: r["lines"]).alias("blocks"))
    return gates.line_boxes(nested)


@query(f"""WITH {LINES} SELECT doc_id, para::INT AS para, {_PROBLEMS.format("CASE WHEN (disposition = 'translatable') <> (disposition = 'translatable' AND length(source_text) >= 3) THEN 'unit' END, CASE WHEN source_text = '' THEN 'box' END")} AS problems FROM rec""")
def pr03_segment_records(spark, sf):
    """Every line as a record whose unit is there from three characters on and whose box is there unless it is empty."""
    r = records.segment(docs(spark, sf))
    unit = (F.col("disposition") == "translatable") & (F.length("source_text") >= 3)
    box = F.col("source_text") != ""
    return r.select("doc_id", F.col("para").cast("int").alias("para"), constraints.record_problems(F.col("disposition"), F.col("reason"), unit, box, F.lit(False)).alias("problems"))


@query(f"""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
e AS (SELECT a.conv_id, a.text <> b.text AS changed, CASE WHEN length(b.text) * 4 < length(a.text) THEN 'DEGRADES' WHEN length(b.text) > length(a.text) THEN 'IMPROVES' ELSE 'EQUIVALENT' END AS impact, coalesce(toxic = 1, false) AS serious, coalesce(quality, 1) = 1 AS passed
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.turn = 0 LEFT JOIN l ON l.doc_id = a.conv_id)
SELECT conv_id, {_PROBLEMS.format("CASE WHEN NOT changed AND impact <> 'EQUIVALENT' THEN 'unchanged' END, CASE WHEN passed <> (NOT serious AND impact <> 'DEGRADES') THEN 'verdict' END")} AS problems FROM e""")
def pr17_turn_verdicts(spark, sf):
    """Second turns as edits of first ones; the impact is their length, labels of the same number give findings and verdicts."""
    c = tab(spark, sf, "conversations")
    pair = c.where("turn = 0").select("conv_id", F.col("text").alias("a")).join(c.where("turn = 1").select("conv_id", F.col("text").alias("b")), "conv_id")
    labels = tab(spark, sf, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    j = pair.join(labels, "conv_id", "left")
    impact = F.when(F.length("b") * 4 < F.length("a"), "DEGRADES").when(F.length("b") > F.length("a"), "IMPROVES").otherwise("EQUIVALENT")
    verdict = F.when(F.coalesce("quality", F.lit(1)) == 1, "PASS").otherwise("BLOCK")
    return j.select("conv_id", constraints.verdict_problems(verdict, F.coalesce(F.col("toxic") == 1, F.lit(False)), impact, F.col("a") != F.col("b")).alias("problems"))
