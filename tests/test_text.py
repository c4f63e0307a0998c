"""What normalisation leaves to Python, for every character."""

import re
import sys
import unicodedata

from pyspark.sql import functions as F

from ledgerloom.functions import text as tx


def test_only_texts_that_nfc_may_change_go_to_python(spark):
    every = [c for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff"]
    pairs = {tuple(unicodedata.normalize("NFD", c)) for c in every}
    later = {x for p in pairs for x in p[1:]}
    touched = [c for c in every if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c) or c in later]
    df = spark.createDataFrame([(c,) for c in touched], "t string")
    assert [r.t for r in df.where(~F.col("t").rlike(tx.NOT_NFC)).collect()] == []
    plain = spark.createDataFrame([("Größe, señor, élève",), ("a\r\nb",)], "t string")
    assert plain.where(F.col("t").rlike(tx.NOT_NFC)).count() == 0


def test_normal_and_folded_texts(spark):
    texts = ["été", "Straße", "ẛ̣", "가", "가", "Å", "K", "a\r\nb\rc", "", None, "PLAIN", "ſ", "İ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize_text(F.col("t")).alias("n"), tx.fold(F.col("t")).alias("f")).collect()
    for r in rows:
        assert (r.n, r.f) == ((None, None) if r.t is None else (unicodedata.normalize("NFC", re.sub("\r\n?", "\n", r.t)), r.t.casefold()))
