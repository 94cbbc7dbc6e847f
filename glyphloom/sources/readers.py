"""Readers: transcripts, provenance tables, line lists, metric reports, binary containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "tool string, tool_version string, subset string, metric_version string, superseded string, summary struct<n_documents:bigint,n_failures:bigint,failures:array<string>,char_accuracy:double,diacritic_accuracy:double,syllable_accuracy:double>, documents array<struct<document:string,char_accuracy:double,diacritic_accuracy:double,syllable_accuracy:double,truth_chars:bigint,diacritic_positions:bigint>>"


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """document (the file's stem) and text of every .txt of a folder."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return raw.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("document"), F.col("value").alias("text"))


def provenance(spark: SparkSession, path: str, heading: str = "## Files") -> DataFrame:
    """The cells (array of strings) of each row of the Markdown table under a heading, without its header and rule."""
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(x))
    raw = spark.read.text(path, wholetext=True).select(lines.alias("l")).select(F.expr("slice(l, array_position(l, '" + heading + "') + 1, size(l))").alias("l"), F.array_position("l", heading).alias("at")).filter("at > 0")
    end = F.array_position(F.transform("l", lambda x: x.startswith("#")), True)
    kept = raw.select(F.posexplode(F.when(end > 0, F.expr("slice(l, 1, cast(array_position(transform(l, x -> startswith(x, '#')), true) as int) - 1)")).otherwise(F.col("l"))).alias("n", "line")).filter("line like '|%|' and not line rlike '^[|:\\\\s-]+$'")
    first = kept.agg(F.min("n").alias("first"))
    rows = kept.join(F.broadcast(first), F.col("n") > F.col("first"))
    return rows.select("n", F.transform(F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|"), lambda x: F.trim(F.translate(x, "`", ""))).alias("cells"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a list, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '#')")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(REPORT).json(folder, multiLine=True)


def containers(spark: SparkSession, folder: str, suffixes: str = "*.{rtf,doc,xls,ppt,pdf}", most: int = 0) -> DataFrame:
    """path and content of binary files; those over `most` bytes (0: no limit) are left out before any content is read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", suffixes).option("recursiveFileLookup", "true").load(folder)
    return (raw.filter(F.col("length") <= most) if most else raw).select("path", "content")


MANIFEST = "map<string, struct<paragraphs:int, headings:array<string>, table:array<array<string>>>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """document, paragraphs, headings and table of each entry of a structure manifest (a JSON object by file)."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", MANIFEST)).alias("document", "spec"))
    return raw.select("document", "spec.*")
