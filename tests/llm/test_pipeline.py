"""The pipeline's stages, on small tables with odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphloom.llm import mixing
from glyphloom.llm.common import cleared, staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"word{i}" for i in range(3_000))
    odd = spark.createDataFrame([(None, long + " null", "en", "a", 1), (900_001, None, None, None, None), (900_002, "", "en", "a", 0), (900_003, long, None, None, 1), (900_003, long, None, None, 1), (900_004, long.upper(), "en", "b", 1)], some.select("doc_id", "text", "lang", "source", "n_chars").schema)
    clash = [F.lit(1).alias(c) for c in ("row", "id", "gone", "sha", "key", "rank", "slot", "ids", "mix_slot", "mix_rank", "kept", "decoded", "packed")]
    return some.select(*odd.columns).unionByName(odd).select("*", *clash)


def test_stages(spark, docs):
    now, columns, ids = docs, set(docs.columns), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = staged(stage(spark, now, SF), "stage")
        assert columns <= set(now.columns)
        ids.append(Counter(r["doc_id"] for r in now.select("doc_id").collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "byte-level BPE"]
    quality, exact, near, mix = ids
    assert 900_001 not in quality and 900_002 not in quality and quality[900_003] == 2 and None in quality
    assert exact[900_003] == 0 and exact[900_004] == 1 and all(n == 1 for n in exact.values())
    assert 900_004 in near or None in near
    assert mix == near and set(near) < set(exact) < set(quality)
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == mix
    text = {r["doc_id"]: r["sha"] for r in docs.select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
    assert all(r["decoded_sha256"] == text[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in out.collect())


def test_empty(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = staged(stage(spark, now, SF), "stage")
        assert now.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).select("source", "mix_slot", "mix_rank").collect()
    assert out and [tuple(r)[1:] for r in out] == sorted(tuple(r)[1:] for r in out)
    sizes = Counter(r["source"] for r in out)
    m, seen = mixing.weights(sizes), Counter()
    last = min(max(r["mix_slot"] for r in out if r["source"] == s) for s in sizes)  # until the first source is dry
    for n, r in enumerate(out, 1):
        if r["mix_slot"] > last:
            break
        seen[r["source"]] += 1
        assert all(abs(seen[s] - m[s] * n / sum(m.values())) <= 2 * mixing.BLOCK for s in m)
    cleared(spark)
