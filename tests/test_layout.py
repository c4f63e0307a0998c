"""Laid-out pages by format name: partitions, pushed filters, keys, commits and aborts."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import layout


def pages(spark):
    docs = spark.range(40).select(F.concat(F.lit("p/"), F.col("id") % 3).alias("part"), (F.col("id") - 2).alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("page"))
    paras = docs.select("*", F.lit(600.0).alias("width"), F.lit(800.5).alias("height"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("para"))
    box = F.when(F.col("para") > 0, F.struct(F.lit(1.0).alias("x0"), F.col("para").cast("double").alias("y0"), F.lit(9.25).alias("x1"), F.lit(99.0).alias("y1")))
    return paras.select("*", F.concat(F.lit("Zeile „é\n"), "para").alias("text"), (F.col("para") == 2).alias("vertical"), box.alias("box"))


def test_pages_come_back_with_keys(spark, tmp_path):
    folder = f"file://{tmp_path}/l"
    layout.write(pages(spark), folder)
    got = layout.read(spark, folder)
    assert got.count() == 40 * 2 * 3 and layout.repeated(got).count() == 0
    own = got.drop("record_key", "record_revision")
    want = pages(spark).select(own.columns)
    assert own.exceptAll(want).count() == 0 and want.exceptAll(own).count() == 0
    assert got.select("record_key").distinct().count() == 240 and got.where("record_revision IS NULL").count() == 0
    r = got.where("doc_id = 5 AND page = 1 AND para = 0").first()
    assert r.box is None and r.record_key == layout.place_key(r.part, 5, 1, 0) and r.record_revision == layout.content_key(r.record_key, r.text, False, None)


def test_a_filter_on_part_opens_one_partition(spark, tmp_path):
    folder = f"file://{tmp_path}/l"
    layout.write(pages(spark).coalesce(1), folder)
    every, one = layout.read(spark, folder), layout.read(spark, folder).where("part = 'p/1'")
    n = len(list((tmp_path / "l" / "part=p%2F1").iterdir()))
    assert one.rdd.getNumPartitions() == n < every.rdd.getNumPartitions()
    assert {r.part for r in one.select("part").collect()} == {"p/1"} and one.count() == 13 * 6
    (next(iter((tmp_path / "l" / "part=p%2F2").iterdir()))).write_text("no page\n")
    assert one.count() == 13 * 6  # other parts are not read
    with pytest.raises(Exception, match="no page"):
        every.count()


def test_divergence_and_repetition_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/l"
    layout.write(pages(spark).where("doc_id = 1"), folder)
    (path,) = (p for p in (tmp_path / "l").rglob("*.jsonl"))
    whole = path.read_text()
    first = json.loads(whole.splitlines()[0])
    for change, problem in ((("text", "other"), "not what its key says"), (("box", [0, 0, 1, 1]), "not what its key says"), (("key", "0" * 64), "not what its key says"), (("para", 1), "is repeated|not what")):
        bad = json.loads(json.dumps(first))
        bad["paragraphs"][0 if change[0] != "para" else 2][change[0]] = change[1]
        path.write_text(json.dumps(bad) + "\n")
        with pytest.raises(Exception, match=problem):
            layout.read(spark, folder).collect()
    path.write_text(whole + whole)
    with pytest.raises(Exception, match="page . of document 1 is repeated"):
        layout.read(spark, folder).collect()
    path.write_text(whole)
    (path.parent / "again.jsonl").write_text(whole)
    assert layout.repeated(layout.read(spark, folder)).count() == 6


def test_an_abort_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/l"
    layout.write(pages(spark).where("doc_id = 1"), folder)
    before = sorted(p for p in (tmp_path / "l").rglob("*") if p.is_file())
    broken = pages(spark).withColumn("width", F.when(F.col("doc_id") == 20, F.lit(float("nan"))).otherwise(F.col("width")))  # no JSON number
    with pytest.raises(Exception, match="Out of range float|not JSON compliant"):
        layout.write(broken, folder)
    assert sorted(p for p in (tmp_path / "l").rglob("*") if p.is_file()) == before and layout.read(spark, folder).count() == 6


def test_an_empty_folder(spark, tmp_path):
    assert layout.read(spark, f"file://{tmp_path}/none").count() == 0
