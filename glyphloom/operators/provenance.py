"""Integrity of a provenance ledger, names for collected files, and what is collected already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.functions import naming


def violations(ledger: DataFrame, files: DataFrame, truths: DataFrame) -> DataFrame:
    """file and problem: files without an entry, entries without a file, ready entries without a transcript.

    ledger: file, status; files: file, path (an entry may name either); truths: file. Equi-joins only.
    """
    names = ledger.select(F.col("file").alias("named")).distinct()
    either = files.select("file", F.explode(F.array_distinct(F.array("file", "path"))).alias("named"))
    held = either.join(names, "named", "left_semi").select("file").distinct()
    no_entry = files.select("file").distinct().join(held, "file", "left_anti").select("file", F.lit("no entry").alias("problem"))
    gone = names.join(either, "named", "left_anti").select(F.col("named").alias("file"), F.lit("no file").alias("problem"))
    untold = ledger.filter("status = 'ready'").select("file").join(truths.select("file").distinct(), "file", "left_anti").select("file", F.lit("no transcript").alias("problem"))
    return no_entry.unionByName(gone).unionByName(untold)


def fresh(candidates: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """Candidates whose key is new: one of each key, the first by order, and none that seen has."""
    first = candidates.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("rn = 1").drop("rn")
    return first.join(seen.select(key).distinct(), key, "left_anti")


def named(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """candidates (url, timestamp, kind) with the name of the file that each becomes: year-stem.kind.

    Transcripts go by the stem, so a stem belongs to one kind: that of held's (file) names, or else of the first candidate by
    timestamp, url and kind. Candidates of other kinds are named year-stem-kind.kind. Only distinct stems and kinds are shuffled and gathered.
    """
    own = candidates.withColumn("stem", F.concat(F.substring("timestamp", 1, 4), F.lit("-"), naming.safe_stem("url", "kind")))
    taken = held.select(F.regexp_extract("file", r"^(.*)\.[^.]*$", 1).alias("stem"), F.regexp_extract("file", r"\.([^.]*)$", 1).alias("k")).filter(F.col("k").isin(*naming.KINDS)).groupBy("stem").agg(F.collect_set("k").alias("kinds"))
    first = own.groupBy("stem").agg(F.min(F.struct("timestamp", "url", "kind"))["kind"].alias("k"))
    owner = first.join(taken, "stem", "left").select("stem", F.coalesce("kinds", F.array("k")).alias("kinds"))
    clash = F.exists("kinds", lambda k: k != F.col("kind"))
    return own.join(owner, "stem", "left").withColumn("name", F.concat("stem", F.when(clash, F.concat(F.lit("-"), "kind")).otherwise(""), F.lit("."), "kind")).drop("kinds", "stem")


def replaced(ledger: DataFrame, fresh_rows: DataFrame, mark: str) -> DataFrame:
    """The ledger in which rows whose file begins with mark give way to fresh_rows."""
    return ledger.filter(~F.coalesce(F.col("file").startswith(mark), F.lit(False))).unionByName(fresh_rows)


def stem(name) -> F.Column:
    """A file's name without .doc or .docx at its end; other kinds keep theirs."""
    return F.regexp_replace(name, r"\.docx?$", "")


def ready_stems(rows: DataFrame) -> DataFrame:
    """document: the stems of the rows (cells) that are ready."""
    return rows.filter(F.get("cells", F.lit(6)) == "ready").select(stem(F.get("cells", F.lit(0))).alias("document")).distinct()


def by_stem(rows: DataFrame) -> DataFrame:
    """document and cells, the last row of each stem. rows: n, cells."""
    return rows.groupBy(stem(F.get("cells", F.lit(0))).alias("document")).agg(F.max(F.struct("n", "cells"))["cells"].alias("cells"))


def documented(rows: DataFrame, header: list[str]) -> DataFrame:
    """A map from the header's names to the cells of each row."""
    n = F.least(F.size("cells"), F.lit(len(header)))
    return rows.select(F.map_from_arrays(F.slice(F.array(*map(F.lit, header)), F.lit(1), n), F.slice("cells", F.lit(1), n)).alias("row"))


def status_counts(ledger: DataFrame) -> DataFrame:
    """One row: entries, ready and pending."""
    return ledger.agg(F.count("*").alias("entries"), *[F.count_if(F.col("status") == k).alias(k) for k in ("ready", "pending")])
