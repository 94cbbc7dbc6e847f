"""Sinks: reports, predictions, and ledgers of which one subset is replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(summary: DataFrame, documents: DataFrame, folder: str) -> None:
    """JSON lines: folder/summary has a row for each subset, folder/documents one for each document. Letters beyond ASCII stay."""
    for name, df in (("summary", summary), ("documents", documents)):
        df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")


def predictions(parsed: DataFrame, folder: str) -> None:
    """The text of each document in a folder of its own, document=<name>. parsed: document, text."""
    parsed.select("document", "text").write.mode("overwrite").partitionBy("document").option("lineSep", "\n").text(folder)


def replaced(rows: DataFrame, folder: str, by: str = "subset") -> None:
    """Parquet in which the rows of those subsets that rows has give way to them; other subsets stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)
