"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled text, one from good and one
from bad documents. A text is compressed under both, chunk by chunk so that the
dictionaries count for all of it; the difference of the sizes over their sum,
calibrated by logistic regression, is its score.

Fitting takes a bounded sample of labelled rows: SAMPLE rows of each label, of
at most SAMPLE_CHARS characters, those with the smallest hashes of their
doc_ids. Scoring reads every whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import small_batches, table

#: Labelled rows of each label that the fit sees at most; longest text among them; bytes of a dictionary and of a chunk; fold held out.
SAMPLE, SAMPLE_CHARS, DICT_BYTES, CHUNK, FOLDS, HELD = 1_500, 20_000, 112_640, 2_048, 4, 2
THRESHOLD, LEVEL = 0.7, 3


def held_out(doc_id) -> F.Column:
    """Whether the row belongs to the held-out fold. A null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, label) of the bounded sample. Of a document with several labels, only agreeing ones count; null labels and empty texts don't. Of rows that repeat a doc_id the least text counts."""
    one = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi").select("doc_id", F.col("lo").cast("int").alias("label"))
    got = []
    for label in (0, 1):
        picked = one.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # a top-k of ids: bounded
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS)).join(F.broadcast(picked), "doc_id")
        got += sorted((r["doc_id"], r["text"], label) for r in rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    return [(t, y) for _, t, y in got]


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts: trained, or their plain bytes where there are too few to train on."""
    pieces = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[-DICT_BYTES:]


class Scorer:
    """Made of plain bytes and numbers, so that it can be sent to tasks."""

    def __init__(self, good: bytes, bad: bytes, theta: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)) -> None:
        self.good, self.bad, self.theta = good, bad, tuple(theta)
        self._by: list = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_by": []}

    def features(self, text: str) -> tuple[float, float, float, float]:
        """(bad size - good size) / (bad size + good size) over all chunks, the logarithm of how far the text compresses at all, its square, 1."""
        if not self._by:
            for x in (self.good, self.bad):
                own = zstandard.ZstdCompressionDict(x) if x else None
                if own is not None:
                    own.precompute_compress(level=LEVEL)
                self._by.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **({"dict_data": own} if own is not None else {})))
        raw = text.encode("utf-8", "surrogatepass")
        good = bad = 0
        for i in range(0, len(raw), CHUNK):
            piece = raw[i : i + CHUNK]
            good += len(self._by[0].compress(piece))
            bad += len(self._by[1].compress(piece))
        ratio = float(np.log((good + bad + 32) / (2 * len(raw) + 32)))
        return (bad - good) / (bad + good) if bad + good else 0.0, ratio, ratio * ratio, 1.0

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.theta, self.features(text)), -30, 30))))


def fit(rows: list[tuple[str, int]]) -> Scorer:
    """Dictionaries from half of the rows, calibrated on the other half. Without rows of both labels every score is their share of good ones (0.5 of none)."""
    half = [[t.encode("utf-8", "surrogatepass") for t, y in rows[::2] if y == k] for k in (0, 1)]
    if not half[0] or not half[1]:
        share = np.mean([y for _, y in rows]) if rows else 0.5
        return Scorer(b"", b"", (0.0, 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))))
    out = Scorer(_dictionary(half[1]), _dictionary(half[0]))
    rest = rows[1::2] or rows
    x, y = np.array([out.features(t) for t, _ in rest]), np.array([y for _, y in rest], float)
    scale = np.maximum(np.abs(x).max(0), 1e-6)
    z, theta = x / scale, np.zeros(4)
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        g = z.T @ (y - p) - 1e-2 * theta
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(4)
        theta += np.linalg.solve(h, g)
    out.theta = tuple(float(v) for v in theta / scale)
    return out


def classify(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null text counts as empty. Only the text enters the score.

    Rows that repeat are rows of the result, a null doc_id counts as the text '' for held_out, an empty table gives an empty
    result. Texts of any length count whole.
    """

    small_batches(docs.sparkSession)
    def run(batches):
        for pdf in batches:
            out = pdf[["doc_id", "held_out"]].astype({"doc_id": "Int64"})
            out["score"] = pd.Series([scorer.score(t) for t in pdf["text"]], index=out.index, dtype="float64")
            out["predicted"] = (out["score"] >= THRESHOLD).astype("int32")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents scored by a classifier that is fitted on the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(sample(docs, table(spark, sf_dir, "labels"))))
