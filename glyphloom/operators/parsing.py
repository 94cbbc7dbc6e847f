"""The parser under test as a plug-in over Arrow batches, and what it rejects."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.functions.text import bounded

# Characters of what is parsed that a task holds before it gives them on, and what a chunk counts beside its own.
BATCH, CHUNK = 4 << 20, 50


def parsed(files: DataFrame, parse: Callable[[object], tuple[str, list[str]]]) -> DataFrame:
    """document, text, chunks and error of every row of files (document, content).

    parse takes a content and returns its text and its chunks. What it raises is the row's error, with null text and chunks.
    """

    def run(batches):
        columns = ["document", "text", "chunks", "error"]
        for pdf in batches:
            rows, size = [], 0
            for document, content in zip(pdf["document"], pdf["content"], strict=True):
                try:
                    text, chunks = parse(content)
                    chunks = list(chunks)
                    size += sum(len(x) if isinstance(x, str) else CHUNK for x in (text, *chunks)) + CHUNK * len(chunks)
                    rows.append((document, text, chunks, None))
                except Exception as e:  # noqa: BLE001 - any failure of the parser is data
                    rows.append((document, None, None, f"{type(e).__name__}: {e}"))
                if size >= BATCH:  # what is parsed may be far larger than the content
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    bounded(files.sparkSession)
    own = files.select("document", "content")
    return own.mapInPandas(run, f"document {dict(own.dtypes)['document']}, text string, chunks array<string>, error string")


def predictions(out: DataFrame) -> DataFrame:
    """document and text of what was parsed. out: what parsed() gives, staged or cached if rejects are taken too."""
    return out.filter("error is null").select("document", "text")


def rejects(out: DataFrame) -> DataFrame:
    """document and error of what was not."""
    return out.filter("error is not null").select("document", "error")
