"""Objects that are proved when put, digests of large files, differences of releases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import digest_tree
from ledgerloom.sources import blobs


def test_a_damaged_object_is_not_put_over(spark, tmp_path):
    store, df = f"file://{tmp_path}/s", spark.createDataFrame([(b"right",), (b"other",)], "content binary")
    blobs.put(df, store)
    blobs.put(df, store)
    assert blobs.get(spark, store).count() == 2
    sha = hashlib.sha256(b"damaged").hexdigest()
    bad = spark.createDataFrame([(sha, 7, b"Damaged", sha[:2], "x")], "sha256 string, size long, content binary, prefix string, relative_path string")
    bad.write.mode("append").partitionBy("prefix").parquet(store)
    blobs.put(df, store)  # other objects are as they were
    with pytest.raises(blobs.Corrupt, match=sha):
        blobs.put(spark.createDataFrame([(b"damaged",)], "content binary"), store)
    blobs.addressed(df.where(F.col("content") == F.lit(b"right"))).write.mode("append").partitionBy("prefix").parquet(store)  # a second writer at once
    assert blobs.get(spark, store).count() == 4 and blobs.once(blobs.get(spark, store)).count() == 3


def test_files_are_digested_in_blocks(spark, tmp_path):
    want = {}
    for name, size in (("empty", 0), ("small", 10), ("large", 300_001), ("with space é", 200_000)):
        data = (name.encode() * (size // len(name) + 1))[:size]
        (tmp_path / name).write_bytes(data)
        want[name] = (hashlib.sha256(data).hexdigest(), size)
    for whole in (1 << 26, 1000):
        got = {r.name.replace("%20", " "): (r.sha256, r.size) for r in blobs.digest_files(spark, f"file://{tmp_path}", whole, block=4096).collect()}
        assert sorted(v for v in got.values()) == sorted(want.values())


def test_a_sparse_file_beyond_two_gib(spark, tmp_path):
    path = tmp_path / "big"
    with open(path, "wb") as f:
        f.truncate((2 << 30) + 5)
        f.seek(0)
        f.write(b"start")
    h, zeros = hashlib.sha256(b"start"), bytes(1 << 20)
    for _ in range((2 << 10) - 1):
        h.update(zeros)
    h.update(bytes((1 << 20) + 5 - 5))
    r = blobs.digest_files(spark, f"file://{path}").first()
    assert (r.size, r.sha256) == ((2 << 30) + 5, h.hexdigest())


def test_differences_are_found_where_they_are(spark, tmp_path):
    rows = spark.range(60_000).select(((F.col("id") - 30_000) * 7).alias("doc_id"), F.lit(0).alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("outcome_id"))
    after = rows.where("doc_id <> 700").withColumn("outcome_id", F.when(F.col("doc_id").isin(-210_000, 7), "new").otherwise(F.col("outcome_id")))
    after = after.unionByName(spark.createDataFrame([(10**15, 0, "x")], "doc_id long, pos int, outcome_id string"))
    a, b = (f"file://{tmp_path}/{n}" for n in "ab")
    digest_tree.store(rows, a)
    digest_tree.store(after, b)
    found, scanned = digest_tree.difference(spark, a, b)
    assert sorted(map(tuple, found.collect())) == [(-210_000, "changed"), (7, "changed"), (700, "removed"), (10**15, "added")]
    assert scanned[0] <= 3 * 4096 and sum(scanned.values()) < 4 * 4096  # not the 60,000 documents
    same, looked = digest_tree.difference(spark, a, a)
    assert same.count() == 0 and list(looked) == [5]
    digest_tree.store(rows.withColumn("outcome_id", F.lit("y")), f"file://{tmp_path}/c")
    assert digest_tree.difference(spark, a, f"file://{tmp_path}/c")[0].count() == 60_000
    digest_tree.store(rows.limit(0), f"file://{tmp_path}/none")
    assert {r.change for r in digest_tree.difference(spark, f"file://{tmp_path}/none", a)[0].collect()} == {"added"}
