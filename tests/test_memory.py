"""What goes to Python is bounded, and only what must goes there."""

import sys
import unicodedata

from pyspark.sql import functions as F

from glyphloom.functions import text as T
from glyphloom.operators import parsing
from glyphloom.plans import catalogue


def test_composed_as_python_does(spark):
    every = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["e" + "".join(every[n : n + 997]) for n in range(0, len(every), 997)] + ["q\u0323\u0307", "q\u0307\u0323", "\u1100\u1161\u11a8", "\u0915\u093c", "Vi\u1ec7t", ""]
    texts += ["a" + c for c in every if unicodedata.combining(c) or unicodedata.decomposition(c)]
    df = spark.createDataFrame([(n, t) for n, t in enumerate([*texts, None])], "n int, t string").repartition(8)
    assert {r.n: r.x for r in df.select("n", T.nfc(F.col("t")).alias("x")).collect()} == {n: t and unicodedata.normalize("NFC", t) for n, t in enumerate([*texts, None])}


def test_synthetic_vni_has_small_batches(spark, tmp_path):
    spark.conf.unset(T.BATCH_SETTING)
    spark.createDataFrame([(1, "Câu một"), (2, "Câu hai")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.QUERIES["synthetic_vni"](spark, str(tmp_path)).count() == 2
    assert int(spark.conf.get(T.BATCH_SETTING).rstrip("b")) == T.BATCH_BYTES


def test_parsed_is_given_on_in_parts(spark):
    spark.conf.unset(T.BATCH_SETTING)
    files = spark.range(60).selectExpr("id as document", "repeat('x', 200000) as content").repartition(1)
    out = parsing.parsed(files, lambda c: (c * 5, [c, None, 7][:2]))
    assert int(spark.conf.get(T.BATCH_SETTING).rstrip("b")) == T.BATCH_BYTES
    got = out.selectExpr("document", "length(text) as n", "size(chunks) as chunks", "error").collect()
    assert len(got) == 60 and {(r.n, r.chunks, r.error) for r in got} == {(1_000_000, 2, None)} and {r.document for r in got} == set(range(60))
