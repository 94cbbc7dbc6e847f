"""The self-test cases of the accuracies, codecs and structure scores."""

from pyspark.sql import functions as F

from glyphloom.functions import codecs
from glyphloom.functions import text as T
from glyphloom.operators import alignment, mixed, structure

SENTENCE = "Căn cứ Luật Tổ chức Chính phủ; theo đề nghị của Bộ trưởng Bộ Tài chính."


def score(spark, got, truth):
    return alignment.scores(spark.createDataFrame([(1, got, truth)], "document long, got string, truth string")).first()


def test_perfect_and_stripped(spark):
    r = score(spark, SENTENCE, SENTENCE)
    assert r["diacritic_accuracy"] == 1.0 and r["syllable_accuracy"] == 1.0 and r["truth_chars"] == len(SENTENCE)
    assert r["char_accuracy"] == round((len(SENTENCE) - 1) / len(SENTENCE), 6)  # the separator of its two segments is not counted
    plain = SENTENCE.translate(str.maketrans(T.FOLD_FROM, T.FOLD_TO))
    r = score(spark, plain, SENTENCE)
    assert r["diacritic_accuracy"] == 0.0 and r["char_accuracy"] > 0.6
    r = score(spark, "", SENTENCE)
    assert r["char_accuracy"] == 0.0 and r["syllable_accuracy"] == 0.0


def test_pieces_are_cut():
    assert len(alignment.pairs("x " * 4000, "y " * 6000)) >= 2
    assert alignment.pairs("a. b", "a. b") == [("a.", "a."), ("b", "b")]


def test_codecs(spark):
    assert len(codecs.TCVN3) == 74 and sum(len(k) == 2 for k in codecs.VNI_DECODE) == 280 and len(codecs.VNI_ENCODE) == 146
    assert "ẳ" not in codecs.VNI_ENCODE
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(codecs.vni_decode(F.lit("Boä Taøi chiùnh, Ñaø Naüng"))) == "Bộ Tài chính, Đà Nẵng"
    every = "".join(codecs.VNI_ENCODE)
    assert one(codecs.vni_decode(codecs.vni_encode(F.lit(every)))) == every
    assert one(codecs.tcvn3_decode(F.lit("céng hoµ x∙ héi"))) == "cộng hoà xã hội"


def test_mixed(spark):
    df = spark.createDataFrame([(1, "Th«ng t−\nBoä Taøi chiùnh\n123\ncéng hoµ")], "doc_id long, text string")
    r = mixed.decode(df).first()
    assert r["text"].split("\n")[1] == "Bộ Tài chính" and r["text"].split("\n")[3] == "cộng hoà" and r["inherited"] >= 1


def test_structure(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(structure.order(arr(1, 2, 3))) == 1.0 and one(structure.order(arr(3, 2, 1))) == 0.0 and one(structure.order(arr(1, 19, 2, 20))) == round(2 / 3, 4)
    present = lambda t, *c: one(structure.row_present(F.lit(t), list(c)))
    assert not present("a\nb", "a", "b") and present("x a b", "a", "b") and not present("b a", "a", "b")
    assert not present("240", "24") and present("24", "24") and present("(24)", "24")
    assert one(structure.heading_recall(F.lit("## Title \n\nx"), arr("Title"))) == 1.0 and one(structure.heading_recall(F.lit("Title"), arr("Title"))) == 0.0
