"""Ledger-first incremental collection as a file-source stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collect(spark: SparkSession, source: str, schema: str, ledger: str, out: str, checkpoint: str, key: str = "name"):
    """A query that takes up new files of source once. Each batch enters its keys in the ledger, then writes its rows.

    A batch that is run again after a failure finds its own entries by batch number, so rows are neither lost nor doubled.
    """

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        own.createDataFrame([], f"{key} string, batch bigint").write.mode("append").parquet(ledger)
        seen = own.read.parquet(ledger).filter(F.col("batch") != number).select(key).distinct()
        new = batch.dropDuplicates([key]).join(seen, key, "left_anti")
        entered = own.read.parquet(ledger).filter(F.col("batch") == number).select(key)
        new.select(key, F.lit(number).cast("bigint").alias("batch")).join(entered, key, "left_anti").write.mode("append").parquet(ledger)
        new.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
