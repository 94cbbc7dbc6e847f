"""Decoding, diacritics and the gate on texts that the test tables don't have."""

import random
import time
import unicodedata

from pyspark.sql import functions as F

from glyphloom.functions import codecs, screening
from glyphloom.functions import text as T
from glyphloom.operators import mixed, synthetic


def one(spark, made, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(made).first()[0]


def test_diacritics(spark):
    assert one(spark, T.diacritics(F.col("t")), t="x\u0301 q\u0323 \u00e0b \u0111") == 4


def test_composed(spark):
    loose = "e\u0302"
    assert one(spark, codecs.tcvn3_convert(F.col("t")), t=loose) == one(spark, codecs.vni_convert(F.col("t")), t=loose) == "\u00ea"


def test_gate_without_text(spark):
    df = spark.createDataFrame([(["VNI-Times", ".VnTime"], None, True), (["Arial"], None, True)], "fonts array<string>, text string, is_doc boolean")
    assert [r[0] for r in df.select(screening.classify(F.col("fonts"), F.col("text"), F.col("is_doc"))).collect()] == ["tcvn3", None]


def plainly_decoded(text):
    out, n = [], 0
    while n < len(text):
        size = 2 if text[n : n + 2] in codecs.VNI_DECODE and n + 1 < len(text) else 1
        out.append(codecs.VNI_DECODE.get(text[n : n + size], text[n : n + size]))
        n += size
    return "".join(out)


def _mixtures():
    rnd = random.Random(3)
    letters = [*"aeiouyAxZ \n.", *(c for k in codecs.VNI_DECODE for c in k), *codecs.VNI_ENCODE, "ẳ", "ß", "中", "\U0001f600", "̂"]
    return ["", *map(str, codecs.VNI_DECODE), *("".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(400))]


def test_vni_codecs_by_character(spark):
    texts = _mixtures()
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    made = {r.t: r for r in df.select("t", codecs.vni_decode(F.col("t")).alias("d"), codecs.vni_encode(F.col("t")).alias("e"), codecs.vni_encodable(F.col("t")).alias("can")).collect()}
    for t in texts:
        assert made[t].d == plainly_decoded(t) and made[t].e == "".join(codecs.VNI_ENCODE.get(c, c) for c in t)
        assert made[t].can == (not any(unicodedata.category(c)[0] == "L" and ord(c) > 127 and c not in codecs.VNI_ENCODE for c in t))
    assert made[None].d is made[None].e is made[None].can is None


def _seconds(spark, c, text):
    df = spark.range(0, 40, 1, 8).select(F.repeat(F.lit(text), 20_000).alias("t"))
    began = time.time()
    df.select(c(F.col("t"))).write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_vni_encode_takes_runs_at_a_time(spark):
    assert _seconds(spark, codecs.vni_encode, "the words of a text, and Việt ") < 6


def test_vni_roundtrip_takes_runs_at_a_time(spark):
    assert _seconds(spark, lambda t: codecs.vni_decode(codecs.vni_encode(t)) == t, "the words of a text, and Việt Nam được đến ") < 6


def test_dropped_takes_runs_at_a_time(spark):
    one = F.repeat(F.lit("the words of a text, and Việt Nam được đến "), 20_000)
    df = spark.range(0, 40, 1, 8).select(F.col("id").alias("document"), F.concat(F.lit("ẳ\n"), one, F.lit("\n\n"), one).alias("text"))
    began = time.time()
    assert [tuple(r) for r in synthetic.dropped(synthetic.vni_lines(df)).collect()] == [("ẳ", 40)]
    assert time.time() - began < 20


def test_mixed_lines_in_one_pass(spark):
    df = spark.createDataFrame([(1, "Th«ng t−\nBoä Taøi\nÿ¿ Taøi hoµ\n12")], "doc_id long, text string").repartition(2)
    made = mixed.decode(df)
    assert made.first().asDict() == {"doc_id": 1, "text": "Thông tư\nBộ Tài\nÿ¿ Taứi hoà\n12", "tcvn3": 2, "vni": 1, "inherited": 1, "by_token": 0}
    plan = made.select("doc_id", "tcvn3", "vni", "inherited")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Window" not in plan  # counts alone need no second reading
