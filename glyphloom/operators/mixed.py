"""Decoding of documents that change encoding from line to line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions import codecs
from glyphloom.functions.text import SPACE

TOKEN_MARGIN = 2


def line_class(line: Column) -> Column:
    """tcvn3, vni, or null for a line without evidence."""
    t, v = codecs.misread(codecs.tcvn3_decode(line)), codecs.misread(codecs.vni_decode(line))
    read = F.transform(F.array(F.struct(t.alias("t"), v.alias("v"))), lambda x: F.when(x["t"] == x["v"], F.lit(None).cast("string")).when(x["v"] < x["t"], "vni").otherwise("tcvn3"))  # each reading is made once
    return F.when(codecs.high_count(line) == 0, F.lit(None).cast("string")).otherwise(F.element_at(read, 1))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, decided and state (what is decided, or else the last decision; tcvn3 at first)."""
    out = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("decided", line_class(F.col("line")))
    before = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("state", F.coalesce(F.last("decided", ignorenulls=True).over(before), F.lit("tcvn3")))


def _by_token(line: Column, state: Column) -> Column:
    """The line read token by token, switching where a token clearly reads better."""
    parts = F.regexp_extract_all(line, F.lit(f"[{SPACE}]+|[^{SPACE}]+"), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        t, v = codecs.misread(codecs.tcvn3_decode(x)), codecs.misread(codecs.vni_decode(x))
        now = F.when((codecs.high_count(x) > 0) & (F.abs(t - v) >= TOKEN_MARGIN), F.when(v < t, "vni").otherwise("tcvn3")).otherwise(acc["state"])
        return F.struct(now.alias("state"), F.concat(acc["out"], F.when(now == "vni", codecs.vni_decode(x)).otherwise(codecs.tcvn3_decode(x))).alias("out"))

    return F.aggregate(parts, F.struct(state.alias("state"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def decode(docs: DataFrame) -> DataFrame:
    """doc_id, text, and how many lines were decided as either, inherited, or read by token. Null texts give no row."""
    plain = lines(docs).withColumn("plain", F.when(F.col("state") == "vni", codecs.vni_decode(F.col("line"))).otherwise(codecs.tcvn3_decode(F.col("line"))))
    # In one pass, so that nothing is read or dealt twice; only the few lines with a residue get the second reading.
    both = plain.withColumn("again", F.when(codecs.residue(F.col("plain")) > 0, _by_token(F.col("line"), F.col("state"))))
    both = both.withColumn("by_token", F.coalesce(codecs.residue(F.col("again")) < codecs.residue(F.col("plain")), F.lit(False)))
    both = both.withColumn("read", F.when(F.col("by_token"), F.col("again")).otherwise(F.col("plain")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "read"))), lambda x: x["read"]), "\n")
    return both.groupBy("doc_id").agg(text.alias("text"), *[F.count_if(F.col("decided") == k).alias(k) for k in ("tcvn3", "vni")], F.count_if(F.col("decided").isNull()).alias("inherited"), F.count_if("by_token").alias("by_token"))
