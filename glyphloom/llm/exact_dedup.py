"""Exact deduplication by an extendible-hash index on shared files.

Each text has a 64-bit key. The index holds one entry per key, made from
counts that each task has summed before they are shuffled. Its directory maps a
key's leading bits to a bucket: it doubles while a bucket holds more entries
than CAPACITY, and only overfull buckets split. The entries are written to the
shared folder in the order of buckets and keys.

An entry with one row is settled: its row is alone. The texts of all other keys
go to owner tasks, each of which has a range of buckets and keys. There the rows
of a key form a chain of distinct texts, told apart byte by byte, and every
link of the chain is a group of its own; a collision of keys costs a link and
never merges different texts. Each task first puts its rows of one text together
(at most PART of them), so an owner gets a large group as few rows.

Only DataFrame operations are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.llm.common import dropped, lowered, rowed, sized, staged, table

#: Entries that a bucket holds at most, bits of the longest prefix, rows of one text that are put together on average at most.
CAPACITY, MAX_DEPTH, PART = 1_000_000, 20, 10_000


def directory(histogram: dict[int, int], depth: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(first prefix, prefixes, bucket) of each bucket, given the entries of each prefix of depth bits. Buckets are numbered in key order.

    Starts from one bucket; overfull ones split by the next bit, and the directory doubles as their depth needs.
    """
    sums = [histogram]
    for _ in range(depth):  # entries of all prefixes, level by level
        up: dict[int, int] = {}
        for p, n in sums[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        sums.append(up)
    out, open_ = [], [(0, 0)]  # depth, prefix
    while open_:
        d, p = open_.pop()
        if d < depth and sums[depth - d].get(p, 0) > capacity:
            open_ += [(d + 1, 2 * p + 1), (d + 1, 2 * p)]
        else:
            out.append((p << (depth - d), 1 << (depth - d), len(out)))
    return out


def index(keyed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index on shared files: key, rows, top (largest doc_id), sha (of a key with one row, that row's) and bucket.

    The directory has at most 16 prefixes for each bucket that the entries need, and 2**MAX_DEPTH in all.
    """
    entries = staged(keyed.groupBy("key").agg(F.count("*").alias("rows"), F.max("doc_id").alias("top"), F.max("sha").alias("sha")), "entries")
    depth = min(MAX_DEPTH, max(1, (16 * entries.count() // capacity).bit_length()))
    prefix = F.shiftrightunsigned("key", 64 - depth).cast("int")
    made = directory(dict(map(tuple, entries.groupBy(prefix).count().collect())), depth, capacity)
    spark = keyed.sparkSession
    if len(made) == 1:
        owned = entries.withColumn("bucket", F.lit(0))
    else:
        of = spark.createDataFrame(made, "first int, n int, bucket int").select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("prefix"), "bucket")
        owned = entries.withColumn("prefix", prefix).join(F.broadcast(of), "prefix").drop("prefix")  # at most 2**MAX_DEPTH rows of 12 bytes
    out = staged(owned.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index")
    dropped(entries)
    return out


def groups(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs.

    Null text counts as empty, and all empty texts are equal. Of equal texts the largest doc_id stays; null doc_ids are
    smaller than all others (keep_id is null, and kept true, for a group of only such rows). Rows that repeat a doc_id
    with the same text have the same kept; rows that repeat it with another text belong to other groups. No row is lost;
    an empty table gives an empty result. Only doc_id and text are read. key: any function of the text; a poor one costs time.
    """
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered(F.col("text")).alias("low"))
    keyed = low.withColumn("key", key(F.col("low")).cast("long"))
    entries = index(keyed.withColumn("sha", F.unhex(F.sha2("low", 256))), capacity)
    alone = entries.filter("rows = 1").select(F.col("top").alias("doc_id"), F.col("top").alias("keep"), F.lit(1).cast("long").alias("n"), "sha")
    shared = staged(entries.filter("rows > 1").select("key", "bucket", "rows"), "shared")
    # A text that has met its key elsewhere goes to its owner: once for each PART of its rows, in this task's count.
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("rows") / PART)).cast("int")
    met = keyed.join(sized(shared, 40), "key").groupBy("bucket", "key", "low", part.alias("part"))
    met = met.agg(F.collect_list(F.struct("doc_id")).alias("ids"), F.count("*").alias("here"), F.max("doc_id").alias("top"))
    chain = W.partitionBy("bucket", "key").orderBy(F.octet_length("low"), "low")
    owners = staged(met, "met").repartitionByRange("bucket", "key").withColumn("link", F.dense_rank().over(chain))
    link = W.partitionBy("bucket", "key", "link")
    linked = owners.select("ids", F.max("top").over(link).alias("keep"), F.sum("here").over(link).alias("n"), F.unhex(F.sha2("low", 256)).alias("sha"))
    rest = linked.select(F.explode("ids").alias("id"), "keep", "n", "sha").select(F.col("id.doc_id").alias("doc_id"), "keep", "n", "sha")
    out = alone.unionByName(rest)
    return out.select("doc_id", F.col("keep").alias("keep_id"), F.col("n").cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep"), F.col("keep").isNull()).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns, whatever their names; of rows that repeat doc_id and text one, the least by a hash of all its columns."""
    every = staged(groups(docs), "groups")
    gone = staged(every.filter("not kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")).distinct(), "gone")
    again = staged(every.filter("kept").groupBy(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")).count().filter("count > 1").select("id", "sha"), "again")
    rows = rowed(docs, docs["doc_id"].cast("long").alias("id"), F.unhex(F.sha2(lowered(docs["text"]), 256)).alias("sha"))

    def of(left: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        right = sized(ids, 120).select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"))
        return left.join(right, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), how)

    left = of(rows, gone, "left_anti")
    if not again.limit(1).count():
        return left.select("row.*")
    one = of(left, again, "left_semi").groupBy("id", "sha").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return of(left, again, "left_anti").select("row").unionByName(one.select("row")).select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its group; null text counts as empty."""
    return groups(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
