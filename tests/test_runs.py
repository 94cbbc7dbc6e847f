"""Readers, sinks, the ledger stream and the made-up corpora, on files that the tests make."""

import json
import textwrap

from pyspark.sql import functions as F

from glyphloom.operators import parsing, provenance, runs, structure, synthetic
from glyphloom.sources import readers, writers
from glyphloom.streaming import ledger

PROVENANCE = """# Title

| file | x |
|---|---|
| `no.doc` | ready |

## Files

| file | source | wayback | retrieved | publisher | basis | transcript | encoding |
|---|---|---|---|---|---|---|---|
| `a.doc` | s | w | 2024-01-01 | p | law | ready | tcvn3 |
| `b.docx` | s | w | 2024-01-02 | p | law | pending | vni |
| `c.rtf` | s | w | 2024-01-03 | q | law | ready | tcvn3 |

## After

| `d.doc` | s |
"""


def test_provenance_forms(spark, tmp_path):
    (tmp_path / "P.md").write_text(PROVENANCE)
    rows = readers.provenance(spark, str(tmp_path / "P.md"))
    assert sorted(r.cells[0] for r in rows.collect()) == ["a.doc", "b.docx", "c.rtf"]
    assert sorted(r.document for r in provenance.ready_stems(rows).collect()) == ["a", "c.rtf"]
    assert {r.document: r.cells[4] for r in provenance.by_stem(rows).collect()} == {"a": "p", "b": "p", "c.rtf": "q"}
    assert sorted((r.row["file"], r.row["transcript"]) for r in provenance.documented(rows, ["file", "source", "wayback", "retrieved", "publisher", "basis", "transcript", "encoding"]).collect())[0] == ("a.doc", "ready")
    made = spark.createDataFrame([("a", 1)], "document string, lines int")
    assert synthetic.inherited(made, provenance.by_stem(rows)).first().cells[5] == "law"


def test_transcripts_and_lists(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("một\nhai")
    (tmp_path / "t" / "y.md").write_text("no")
    assert [tuple(r) for r in readers.transcripts(spark, str(tmp_path / "t")).collect()] == [("x", "một\nhai")]
    (tmp_path / "l").write_text("# no\n\n a.vn \nb.vn\n")
    assert sorted(r.line for r in readers.lines(spark, str(tmp_path / "l")).collect()) == ["a.vn", "b.vn"]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.rtf").write_bytes(b"x" * 10)
    (tmp_path / "bin" / "b.rtf").write_bytes(b"x" * 100)
    assert [r.path.rsplit("/", 1)[1] for r in readers.containers(spark, str(tmp_path / "bin"), most=50).collect()] == ["a.rtf"]


def test_structure_run(spark, tmp_path):
    table_ = [["Mã", "Tên"], ["1", "An (x)"], ["2", r"B\E.c"]]
    spec = {k: {"paragraphs": 3, "headings": ["Phần I", "Phần II"], "table": table_} for k in ("a", "b", "gone")}
    (tmp_path / "m.json").write_text(json.dumps(spec))
    manifest = readers.manifest(spark, str(tmp_path / "m.json"))
    chunks = ["Mã Tên\n1 An (x)", "2 B\\E.c", "12 An (x)"]
    text = "# Phần I\nĐoạn số 1. x\nĐoạn số 3. x\nĐoạn số 2. x"
    read = spark.createDataFrame([("a", text, chunks), ("b", "", [])], "document string, text string, chunks array<string>")
    scores = structure.document_scores(read, manifest)
    got = {r.document: r for r in scores.collect()}
    assert (got["a"].order, got["a"].completeness, got["a"].headings, got["a"].headings_missing) == (0.5, 1.0, 0.5, ["Phần II"])
    assert (got["a"].rows_recovered, got["a"].chunks_with_rows, got["a"].chunks_missing_header, got["a"].header_always_present) == (1.0, 2, 1, False)
    assert (got["b"].order, got["b"].completeness, got["b"].rows_recovered, got["b"].header_always_present) == (1.0, 0.0, 0.0, True)
    assert [r.document for r in structure.not_scored(manifest, read).collect()] == ["gone"]
    assert tuple(structure.means(scores).first()) == (2, 0.75, 0.5, 0.25, 1)
    assert tuple(structure.means(scores.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0)
    # The form with constant cells gives the same.
    one = spark.createDataFrame([(chunks,)], "chunks array<string>").select(structure.table_scores(F.col("chunks"), table_).alias("t")).first().t
    assert tuple(one) == (1.0, 2, 1, False)


def test_parser_and_sinks(spark, tmp_path):
    def parse(content):
        if not content:
            raise ValueError("empty")
        return content.decode(), content.decode().split(" ")

    files = spark.createDataFrame([("a", bytearray("một hai".encode())), ("b", bytearray(b"")), ("c", None)], "document string, content binary")
    out = parsing.parsed(files, parse)
    assert [tuple(r) for r in parsing.predictions(out).collect()] == [("a", "một hai")]
    assert sorted(tuple(r) for r in parsing.rejects(out).collect()) == [("b", "ValueError: empty"), ("c", "ValueError: empty")]
    writers.predictions(parsing.predictions(out), str(tmp_path / "pred"))
    assert [(r.document, r.value) for r in spark.read.text(str(tmp_path / "pred"), wholetext=True).collect()] == [("a", "một hai\n")]
    writers.report(spark.createDataFrame([("s", None)], "subset string, score double"), parsing.predictions(out), str(tmp_path / "report"))
    told = [r.value for r in spark.read.text(str(tmp_path / "report" / "*")).collect()]
    assert sorted(told) == ['{"document":"a","text":"một hai"}', '{"subset":"s","score":null}']
    writers.replaced(spark.createDataFrame([("a", "x"), ("b", "y")], "file string, subset string"), str(tmp_path / "led"))
    writers.replaced(spark.createDataFrame([("c", "y")], "file string, subset string"), str(tmp_path / "led"))
    assert sorted((r.file, r.subset) for r in spark.read.parquet(str(tmp_path / "led")).collect()) == [("a", "x"), ("c", "y")]


def test_made_text(spark):
    text = "a b c d e f\n\n  \nxyz " * 3
    df = spark.createDataFrame([(1, text), (2, None)], "k int, text string").withColumn("w", synthetic.wrapped(F.col("text"), 5))
    want = [y for x in text.splitlines() for y in ([""] if not x.strip() else textwrap.wrap(x, width=5) or [""])]
    got = {r.k: r for r in df.select("k", "w", synthetic.drawn(F.col("w"), 2, 2).alias("d"), synthetic.degraded(F.col("text"), F.col("k"), 3).alias("g"), synthetic.degraded(F.col("text"), F.col("k"), 3).alias("h")).collect()}
    assert got[1].w == want and got[1].d == "\n".join(want[:4]) and got[2].w is None
    assert got[1].g == got[1].h and len(text) // 3 < len(got[1].g) < len(text)
    docs = spark.createDataFrame([("b", "Bộ Tài chính\n\nẳ\nĐà Nẵng"), ("a", "x"), ("c", "ẳ")], "document string, text string")
    assert [r.document for r in synthetic.sources(docs, docs.filter("document <> 'a'"), 1).collect()] == ["b"]
    lines = synthetic.vni_lines(docs)
    assert {r.document: r.truth for r in synthetic.vni_corpus(lines).collect()} == {"a": "x\n", "b": "Bộ Tài chính\nĐà Nẵng\n"}
    assert [tuple(r) for r in synthetic.dropped(lines).collect()] == [("ẳ", 2)]


def test_screening_reports(spark):
    pages = spark.createDataFrame([("a", i, 0 if i < 12 else 10_000, 1) for i in range(20)] + [("b", 0, 50, 0), ("c", 0, 50, 1)], "document string, page_no int, chars int, images int")
    got = {r.document: (r.kind, r.pages, r.chars_per_page, r.image_pages, r.sampled) for r in runs.verdicts(pages).collect()}
    assert got == {"a": ("scan", 20, 0.0, 1.0, True), "b": ("digital", 1, 50.0, 0.0, False), "c": ("mixed", 1, 50.0, 1.0, False)}
    kinds = spark.createDataFrame([("scan",), ("throttled",), ("throttled",), ("unfetched",)], "kind string")
    assert tuple(runs.shares(kinds).first()) == (4, 2, 0.5, 1, 0.25) and runs.shares(kinds.limit(0)).first().throttled_share == 0
    assert [tuple(r) for r in runs.counts(kinds, "kind").collect()] == [("scan", 1), ("throttled", 2), ("unfetched", 1)]
    found = spark.createDataFrame([("http://x/a.doc?b=1", "20040102000000", "vni", [f"f{i}" for i in range(8)], 3), ("http://x/n", "20040102000000", None, [], 3)], "url string, timestamp string, encoding string, fonts array<string>, bytes int")
    hit = runs.hits(found).collect()
    assert len(hit) == 1 and (hit[0].file, str(hit[0].retrieved), len(hit[0].fonts)) == ("a.doc", "2004-01-02", 6)
    assert [r.x for r in spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"<html"),), (None,)], "c binary").select(runs.is_pdf(F.col("c")).alias("x")).collect()] == [True, False, False]


def test_ledger_takes_each_name_once(spark, tmp_path):
    run = lambda: ledger.collect(spark, str(tmp_path / "in"), "name string, text string", str(tmp_path / "ledger"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([("a", "1"), ("b", "2")], "name string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([("b", "3"), ("c", "4")], "name string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted((r.name, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "1"), ("b", "2"), ("c", "4")]
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "ledger")).filter("name is not null").collect()) == ["a", "b", "c"]
