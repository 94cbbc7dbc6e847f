"""What the operators of this subpackage share: inputs, shared storage, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes that a broadcast side may have at most, by its rows and the width that its caller states; above it the same join shuffles.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch; tasks hold a few of them beside what they make of one.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key with more than max(HOT_ROWS, total / HOT_KEYS) rows is hot, so there are at most HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 2_000, 1_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="glyphloom-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/glyphloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def staged(df: DataFrame, name: str, most: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends, lost executors don't matter.

    Its number of rows, rows, is counted as it is written, and so is the largest value of the column most (0 without rows).
    """
    spark = df.sparkSession
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    written = Observation()
    largest = F.max(most) if most else F.lit(None)
    df.observe(written, F.count(F.lit(1)).alias("n"), largest.alias("most")).write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at, out.rows, out.most = path, written.get["n"], written.get["most"] or 0
    return out


def dropped(*dfs: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in dfs:
        _delete(df.sparkSession, df.staged_at)


def cleared(spark: SparkSession) -> None:
    """Deletes all tables that this application has staged. Only for when their results have been read."""
    _delete(spark, _home(spark))


def small_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python at a time to BATCH_BYTES, for the rest of the session, where nobody has set it: plans are made after operators return."""
    if spark.conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):  # Spark's own value
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def by_text(docs: DataFrame, one: Callable[[str], tuple], columns: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and what `one` makes of each whole text (null counts as empty). columns: DDL of what it makes.

    Only key and text are read, so other columns, whatever their names, play no part.
    """
    small_batches(docs.sparkSession)
    names = [x.strip().split(" ")[0] for x in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [one(x if isinstance(x, str) else "") for x in pdf["v"]]
            out = {n: [m[i] for m in made] for i, n in enumerate(names)}
            yield pd.DataFrame({"k": pdf["k"].astype("Int64"), **{n: pd.Series(v, dtype=object) for n, v in out.items()}})

    got = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("v")).mapInPandas(run, f"k long, {columns}")
    return got.withColumnRenamed("k", key)


def lowered(text) -> F.Column:
    """The text (null: empty) with A-Z alone lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, which staged() made, to be broadcast if its rows, of row_bytes each at most, fit in BROADCAST_BYTES; else as it is."""
    return F.broadcast(df) if df.rows <= BROADCAST_BYTES // row_bytes else df


def skew_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "left") -> DataFrame:
    """left, each row with the columns of right's one row of its key (null if there is none, or no row if how is inner); n: rows of left that right's key has.

    Keys with over max(HOT_ROWS, total / HOT_KEYS) rows number at most HOT_KEYS, as their rows sum to total at most.
    They are broadcast; the others are joined in a shuffle in which no key is large.
    """
    hot = right.filter(F.col(n) > max(HOT_ROWS, total // HOT_KEYS))
    cold = right.filter(F.col(n) <= max(HOT_ROWS, total // HOT_KEYS))
    first = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return first.unionByName(rest)


def staged_skew_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "left") -> DataFrame:
    """skew_join with a right that staged() made, with n as most: one plain join where no key is hot, so plans stay small."""
    return skew_join(left, right, key, n, total, how) if right.most > max(HOT_ROWS, total // HOT_KEYS) else left.join(right, key, how)


def rowed(docs: DataFrame, *more: F.Column) -> DataFrame:
    """docs with each whole row in one column, row, beside what the caller adds: no name of docs can clash with those."""
    return docs.select(F.struct("*").alias("row"), *more)
