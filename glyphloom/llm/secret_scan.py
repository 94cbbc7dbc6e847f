"""Secret scans over an incremental ledger of blobs.

Every historical version of a text is a blob, named by the SHA-256 of its
bytes. The ledger, a Parquet folder that outlives a run, holds for each blob
which rule versions have scanned it and what each of them found. A run scans only
pairs of blob and rule version that the ledger lacks, each blob once however many
rows have it, and joins the findings of the rules' present versions back to all
rows (paths) of the blob. Findings of versions or rules that are gone stay in the
ledger and are told no more.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import shared_dir, sized, skew_join, small_batches, staged, table

# The base kinds in their order, then the method's own. (kind, version, literal that a text must hold, pattern, group, least length)
RULES = (
    ("assign", 1, "", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, "AKIA", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 1, "", r"[0-9a-f]{24,}", 0, 24),
    ("pem", 1, "PRIVATE KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", 1, "eyJ", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", 1, "gh", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", 1, "xox", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("maps", 1, "AIza", r"\bAIza[A-Za-z0-9_-]{35,}", 0, 1),
    ("pay", 1, "_live_", r"\b[rs]k_live_[A-Za-z0-9]{16,}", 0, 1),
    ("url", 1, "://", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,200}:[^\s/@]{3,200}@", 0, 1),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<rule:string,s:long,e:long>>"
LEDGER = f"blob binary, done array<string>, found {SPAN}"
#: Both cases of each keyword of assign; a text without any of them needs no search for it.
_WORDS = re.compile("(?i:passw|secret|token|api_?key)", re.ASCII)


def named(rule: tuple) -> str:
    """A rule with its version, as the ledger has it."""
    return f"{rule[0]}@{rule[1]}"


def find(text: str, rules: tuple = RULES) -> list[tuple[str, int, int]]:
    """(rule and version, start, end) in code points of all findings of the rules, by start, then order of the rules, then end."""
    out = []
    for k, rule in enumerate(rules):
        kind, _, literal, pattern, group, least = rule
        if literal and literal not in text or kind == "assign" and not _WORDS.search(text):
            continue
        out += [(m.start(), k, m.end()) for m in re.compile(pattern, re.ASCII).finditer(text) if m.end(group) - m.start(group) >= least]
    return [(named(rules[k]), s, e) for s, k, e in sorted(out)]


def scan(docs: DataFrame, ledger: str, rules: tuple = RULES) -> DataFrame:
    """doc_id, blob (the digest) and found (structs of rule with version, s, e) of every row of docs; adds what it scanned to the ledger.

    Null text counts as empty; without findings, found is an empty array. Rows with a null or repeated doc_id are scanned and
    returned like any other, repeated rows as often as they come. An empty table leaves the ledger as it was. Two rules can
    find the same place; both findings stand. Only doc_id and text are read. The length of a text has no bound.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger)
    by_name = {named(r): r for r in rules}
    now = F.array(*map(F.lit, by_name))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = staged(plain.select("doc_id", "blob"), "paths")
    total = paths.count()
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
    # The ledger's rows of the blobs at hand, which are one for each run that scanned them.
    seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("done"))).alias("seen"))
    todo = F.array_except(now, F.coalesce("seen", F.array().cast("array<string>")))
    blobs = staged(blobs.join(seen, "blob", "left").select("blob", "owner", "n", todo.alias("todo")), "blobs")
    # A row needs no scan if its blob has another owner or has been scanned by all rules. The scan of the rest is a
    # narrow pass over the texts: the rows to leave out are few, or else they come by a shuffle.
    some = blobs.filter((F.col("n") > 1) | (F.size("todo") == 0)).select("blob", "owner", "n", (F.size("todo") == 0).alias("settled"))
    skip = skew_join(paths, some, "blob", "n", total, "inner").filter(F.col("settled") | (F.col("doc_id") != F.col("owner")))
    skip = staged(skip.select(F.col("doc_id").alias("skip_id"), F.col("blob").alias("skip_blob")).distinct(), "skip")
    same = (F.col("blob") == F.col("skip_blob")) & F.col("doc_id").eqNullSafe(F.col("skip_id"))
    fresh = plain.join(sized(skip, 120), same, "left_anti").select("blob", "text")
    partly = staged(blobs.filter((F.size("todo") > 0) & (F.size("todo") < len(rules))).select("blob", "todo"), "partly")  # rules that are newer than the blob's last scan
    if partly.limit(1).count():
        fresh = fresh.join(sized(partly, 120 + 24 * len(rules)), "blob", "left").withColumn("todo", F.coalesce("todo", now))
    else:
        fresh = fresh.withColumn("todo", now)

    def run(batches):
        for pdf in batches:
            found = [[{"rule": k, "s": s, "e": e} for k, s, e in find(t, tuple(by_name[x] for x in todo))] for t, todo in zip(pdf["text"], pdf["todo"], strict=True)]
            yield pd.DataFrame({"blob": pdf["blob"], "done": pdf["todo"], "found": found})

    fresh.mapInPandas(run, LEDGER).write.mode("append").parquet(ledger)
    # One row per blob, whichever runs scanned it. A blob scanned twice (null doc_id) repeats its findings: distinct.
    told = spark.read.schema(LEDGER).parquet(ledger).select("blob", F.filter("found", lambda x: x["rule"].isin(*by_name)).alias("found")).filter(F.size("found") > 0)
    hits = told.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"))
    hits = staged(hits.join(blobs.select("blob", "n"), "blob"), "hits")
    return skew_join(paths, hits, "blob", "n", total).select("doc_id", "blob", F.coalesce("found", F.array().cast(SPAN)).alias("found"))


def digest(found: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The columns of the contract from those of scan()."""
    kinds = [r[0] for r in rules]
    kind = lambda x: F.substring_index(x["rule"], "@", 1)
    place = lambda x: F.array_position(F.array(*map(F.lit, kinds)), kind(x))
    f = F.array_sort(F.transform("found", lambda x: F.struct(x["s"].alias("s"), place(x).alias("k"), x["e"].alias("e"), kind(x).alias("kind"))))
    out = found.select("doc_id", "blob", f.alias("f"))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("f", lambda x: x["kind"].isin(*BASE))
    of = lambda k: F.size(F.filter("f", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(of, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("f")).alias("spans"), F.lower(F.hex("blob")).alias("blob"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its findings, against a ledger that is empty at first; null text counts as empty."""
    return digest(scan(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"))
