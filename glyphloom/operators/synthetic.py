"""Made-up corpora: transcripts encoded as VNI and proved line by line, and wrapped, cut and degraded text."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from glyphloom.functions import codecs
from glyphloom.functions.text import nfc, squeezed

DOCUMENTS, LINES = 12, 120


def sources(transcripts: DataFrame, ready: DataFrame, n: int = DOCUMENTS) -> DataFrame:
    """The first n ready transcripts by name. transcripts: document, text; ready: document."""
    return transcripts.join(ready.select("document").distinct(), "document", "left_semi").orderBy("document").limit(n)


def vni_lines(transcripts: DataFrame, lines: int = LINES) -> DataFrame:
    """document, line_no, line, surface (the line in VNI) and gap, of the first lines of each transcript that aren't blank.

    gap is the first letter that VNI can't write, and null if there is none. kept: no gap, and the surface decodes to the line.
    """
    own = F.slice(F.filter(F.split("text", "\n"), lambda x: squeezed(x) != ""), 1, lines)
    out = transcripts.select("document", F.posexplode(own).alias("line_no", "line")).withColumn("composed", nfc(F.col("line")))
    gap = F.regexp_extract(F.translate("composed", "".join(codecs.VNI_ENCODE), ""), r"[^\P{L}\x00-\x7f]", 0)
    out = out.withColumn("surface", codecs.vni_encode(F.col("composed"))).withColumn("gap", F.nullif(gap, F.lit("")))
    same = codecs.vni_convert(F.col("surface")) == F.col("line")
    return out.select("document", "line_no", "line", "surface", "gap", (F.col("gap").isNull() & same).alias("kept"))


def vni_corpus(lines: DataFrame) -> DataFrame:
    """document, surface and truth of the kept lines; a transcript without any gives no document. lines: what vni_lines gives."""
    told = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", c))), lambda x: x[c]), "\n")
    return lines.filter("kept").groupBy("document").agg(told("surface").alias("surface"), F.concat(told("line"), F.lit("\n")).alias("truth"))


def dropped(lines: DataFrame) -> DataFrame:
    """letter and n, how many lines it stopped, the most frequent first; a null letter stands for lines that failed the round trip."""
    return lines.filter("not kept").groupBy(F.col("gap").alias("letter")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "letter")


def inherited(made: DataFrame, rows: DataFrame) -> DataFrame:
    """Made documents with the ledger's columns of the transcripts that they were drawn from. Both: document."""
    return made.join(rows, "document")


def wrapped(text: Column, columns: int) -> Column:
    """array<string>: each line wrapped to so many columns; blank lines stay."""

    @pandas_udf("array<string>")
    def wrap(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [y for x in t.splitlines() for y in (textwrap.wrap(x, width=columns) or [""])])

    return wrap(text)


def drawn(lines: Column, per_page: int, pages: int = 3) -> Column:
    """The truth of pages that hold so many lines each: the lines that were drawn, and no others."""
    return F.array_join(F.slice(lines, 1, per_page * pages), "\n")


def degraded(text: Column, key: Column, one_in: int = 400) -> Column:
    """The text without about one character in one_in, the same ones in each run: by a hash of key and place. Stands for a scanner's dust."""
    kept = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(F.pmod(F.xxhash64(key, i), F.lit(one_in)) != 0, c)), lambda c: c.isNotNull())
    return F.array_join(kept, "")
