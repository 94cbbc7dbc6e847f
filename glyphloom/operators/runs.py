"""What screening and collection runs report: verdicts on scans, their counts and shares, hits and yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.functions import screening

# Pages that a verdict is formed on; fonts that a hit lists; how a PDF begins.
SAMPLE_PAGES, LISTED_FONTS, MAGIC = 12, 6, b"%PDF-"


def is_pdf(content: Column) -> Column:
    """Whether the bytes begin as a PDF does; an address may answer with a page of HTML."""
    return F.coalesce(F.substring(content, 1, len(MAGIC)) == F.lit(MAGIC), F.lit(False))


def verdicts(pages: DataFrame) -> DataFrame:
    """document, kind, pages, chars_per_page, image_pages and sampled, by the first twelve pages of each document.

    pages: document, page_no (from 0), chars, images (how many the page has).
    """
    early = F.col("page_no") < SAMPLE_PAGES
    share = lambda c: F.sum(F.when(early, c)) / F.count_if(early)
    sums = pages.groupBy("document").agg(F.count("*").alias("pages"), share(F.col("chars")).alias("c"), share(F.when(F.col("images") > 0, 1).otherwise(0)).alias("i"))
    return sums.select("document", screening.scan_kind(F.col("c"), F.col("i"), F.col("pages")).alias("kind"), "pages", F.round("c", 1).alias("chars_per_page"), F.round("i", 2).alias("image_pages"), (F.col("pages") > SAMPLE_PAGES).alias("sampled"))


def counts(rows: DataFrame, by: str) -> DataFrame:
    """by and n, how many rows have it, in the order of by."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(by)


def shares(rows: DataFrame) -> DataFrame:
    """How many of the addresses (kind) were throttled or not fetched, and their shares: what a run has not measured."""
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.agg(F.count("*").alias("n"), *[x for k in ("throttled", "unfetched") for x in (F.count_if(F.col("kind") == k).alias(k), (F.count_if(F.col("kind") == k) / n).alias(f"{k}_share"))])


def yields(screened: DataFrame, *by: str) -> DataFrame:
    """checked, failed and hits by group. screened: fetched (boolean) and encoding (null: no hit). Failures aren't checked."""
    got = F.coalesce("fetched", F.lit(False))
    hit = F.count_if(got & F.col("encoding").isNotNull())
    return screened.groupBy(*by).agg(F.count_if(got).alias("checked"), F.count_if(~got).alias("failed"), hit.alias("hits"), (hit / F.nullif(F.count_if(got), F.lit(0))).alias("yield"))


def hits(screened: DataFrame) -> DataFrame:
    """file, source, retrieved, encoding, fonts (the first six) and bytes of what has an encoding. screened: url, timestamp, encoding, fonts, bytes."""
    name = F.regexp_replace(F.regexp_extract("url", r"([^/]*)$", 1), r"\?.*$", "")
    day = F.to_date(F.substring("timestamp", 1, 8), "yyyyMMdd")
    fonts = F.slice(F.array_sort(F.array_distinct("fonts")), 1, LISTED_FONTS)
    return screened.filter("encoding is not null").select(F.when(name == "", F.col("timestamp")).otherwise(name).alias("file"), F.col("url").alias("source"), day.alias("retrieved"), "encoding", fonts.alias("fonts"), "bytes")
