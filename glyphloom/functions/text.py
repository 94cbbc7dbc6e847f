"""Text functions as native column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as a Unicode string method sees it; Java's \s is ASCII only.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
SEGMENT_END = ".;:!?"
TAB_SHARE = 0.8


def fold_table() -> tuple[str, str]:
    """Letters and what is left of them without diacritics, for all letters up to U+2FFF that decompose to one base."""
    pairs = {"đ": "d", "Đ": "D"}
    for c in map(chr, range(0x80, 0x3000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = fold_table()


@functools.cache
def unsettled() -> str:
    """A class of the characters that composing may change or move, for a pattern: a text without any is composed."""
    maybe = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    own = set()
    for c in range(0x300, sys.maxunicode + 1):
        x = chr(c)
        parts = unicodedata.decomposition(x)
        if unicodedata.combining(x) or not unicodedata.is_normalized("NFC", x):
            own.add(c)
        if parts and parts[0] != "<":
            maybe |= {int(p, 16) for p in parts.split()[1:]}
    at = sorted(own | {c for c in maybe if c >= 0x300})
    starts = [c for c in at if c - 1 not in own | maybe]
    ends = [c for c in at if c + 1 not in own | maybe]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches bounded by bytes where nobody has set them: 10,000 texts, the bound by rows, can be of any size."""
    if spark.conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):  # Spark's own value
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return spark


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Normalisation form C, which Spark lacks; only texts that it may change go to Python."""
    return F.coalesce(_composed(F.when(text.rlike(rf"[\x{{300}}-\x{{10ffff}}&&[{unsettled()}]]"), text)), text)


def squeezed(text: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def normalise(text: Column) -> Column:
    return squeezed(nfc(text))


def base_letters(text: Column) -> Column:
    """The text without diacritics; đ counts as d."""
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), r"\p{Mn}+", "")


def diacritics(text: Column) -> Column:
    """How many characters bear a diacritic: letters that decompose to one, and combining marks."""
    letters = "".join(c for c in FOLD_FROM if unicodedata.category(c)[0] == "L")
    return F.length(text) - F.length(F.regexp_replace(F.translate(text, letters, ""), r"\p{Mn}", ""))


def segments(text: Column) -> Column:
    return F.split(text, rf"(?<=[{SEGMENT_END}])[{SPACE}]+")


def tokens(text: Column) -> Column:
    clean = squeezed(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def is_tabular(text: Column, mark: str = "\t") -> Column:
    """Whether over TAB_SHARE of the lines that aren't blank hold the mark."""
    lines = F.filter(F.split(text, "\n"), lambda x: squeezed(x) != "")
    return F.when(F.size(lines) == 0, False).otherwise(F.size(F.filter(lines, lambda x: F.contains(x, F.lit(mark)))) / F.size(lines) > TAB_SHARE)
