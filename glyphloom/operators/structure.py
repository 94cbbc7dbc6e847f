"""Scores of reading order, completeness, headings and table rows, as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels planted in paragraphs; Markdown headings.
LABEL = r"Đoạn số (\d+)"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85  ]"
HEADING = r"(?md)^#{1,6}\s+(.*\S)\s*$"


def labels(text: Column, pattern: str = LABEL) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def ratio(good: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(F.round(good / total, 4))


def order(found: Column) -> Column:
    """Share of neighbours of which the second is larger; 1 for fewer than two."""
    pairs = F.zip_with(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, F.lit(2), F.size(found)), lambda a, b: b > a)
    return ratio(F.size(F.filter(pairs, lambda x: x)), F.size(pairs))


def completeness(found: Column, expected: Column) -> Column:
    return F.round(F.size(F.array_distinct(found)) / expected, 4)


def missing_headings(text: Column, expected: Column) -> Column:
    """Expected titles that no heading has, repeats and all."""
    found = F.regexp_extract_all(text, F.lit(HEADING), F.lit(1))
    return F.filter(expected, lambda t: ~F.array_contains(found, t))


def heading_recall(text: Column, expected: Column) -> Column:
    return ratio(F.size(expected) - F.size(missing_headings(text, expected)), F.size(expected))


def row_pattern(cells: list[str]) -> str:
    """Matches a line that has all cells in order, none of them glued to a letter or digit."""
    edge = r"[\p{L}\p{N}]"
    one = lambda c: (f"(?<!{edge})" if c[:1].isalnum() else "") + re.escape(c) + (f"(?!{edge})" if c[-1:].isalnum() else "")
    return ".*?".join(one(c) for c in cells)


def row_present(text: Column, cells: list[str]) -> Column:
    pattern = row_pattern(cells)
    return F.exists(F.split(text, LINE_END), lambda x: x.rlike(pattern))


def table_scores(chunks: Column, rows: list[list[str]]) -> Column:
    """rows_recovered, chunks_with_rows, chunks_missing_header, header_always_present; the first of rows is the header."""
    whole = F.array_join(chunks, "\n")
    hit = sum((F.when(row_present(whole, r), 1).otherwise(0) for r in rows[1:]), F.lit(0))
    carry = F.filter(chunks, lambda c: F.exists(F.array(*[row_present(c, r) for r in rows[1:]]), lambda x: x))
    bare = F.filter(carry, lambda c: ~row_present(c, rows[0]))
    return F.struct(ratio(hit, F.lit(len(rows) - 1)).alias("rows_recovered"), F.size(carry).alias("chunks_with_rows"), F.size(bare).alias("chunks_missing_header"), (F.size(bare) == 0).alias("header_always_present"))


def row_pattern_of(cells: Column) -> Column:
    """row_pattern of cells that are data."""
    edge = r"[\p{L}\p{N}]"
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    one = lambda c: F.concat(F.when(c.rlike(f"^{edge}"), f"(?<!{edge})").otherwise(""), quoted(c), F.when(c.rlike(f"{edge}$"), f"(?!{edge})").otherwise(""))
    return F.array_join(F.transform(cells, one), ".*?")


def _has_row(lines: Column, pattern: Column) -> Column:
    return F.exists(lines, lambda x: F.regexp_like(x, pattern))


def document_scores(read: DataFrame, manifest: DataFrame) -> DataFrame:
    """Order, completeness, headings and table rows of every document in both tables.

    read: document, text, chunks (array of strings); manifest: document, paragraphs, headings, table (rows of cells, the header first).
    """
    lines = lambda t: F.split(t, LINE_END)
    patterns = F.transform("table", row_pattern_of)
    both = read.join(manifest, "document").withColumn("head", F.element_at(patterns, 1)).withColumn("rows", F.slice(patterns, F.lit(2), F.size("table")))
    any_row = lambda c: F.exists("rows", lambda p: _has_row(lines(c), p))
    whole = lines(F.array_join("chunks", "\n"))
    out = both.withColumn("labels_read", labels(F.col("text"))).withColumn("found", F.size(F.filter("rows", lambda p: _has_row(whole, p)))).withColumn("carry", F.filter("chunks", any_row))
    out = out.withColumn("bare", F.size(F.filter("carry", lambda c: ~_has_row(lines(c), F.col("head")))))
    return out.select(
        "document", order(F.col("labels_read")).alias("order"), ratio(F.size(F.array_distinct("labels_read")), F.col("paragraphs")).alias("completeness"),
        heading_recall(F.col("text"), F.col("headings")).alias("headings"), missing_headings(F.col("text"), F.col("headings")).alias("headings_missing"),
        ratio(F.col("found"), F.size("rows")).alias("rows_recovered"), F.size("carry").alias("chunks_with_rows"), F.col("bare").alias("chunks_missing_header"), (F.col("bare") == 0).alias("header_always_present"), "labels_read",
    )


def not_scored(manifest: DataFrame, read: DataFrame) -> DataFrame:
    """document: those of the manifest that weren't read."""
    return manifest.join(read.select("document").distinct(), "document", "left_anti").select("document").orderBy("document")


def means(scores: DataFrame) -> DataFrame:
    """One row: n_documents, the plain means of order, completeness and headings (0 without documents), documents_with_orphaned_table_rows."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(c)
    return scores.agg(F.count("*").alias("n_documents"), *map(mean, ("order", "completeness", "headings")), F.count_if(~F.col("header_always_present")).alias("documents_with_orphaned_table_rows"))
