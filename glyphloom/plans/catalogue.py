"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import codecs, screening
from glyphloom.functions import text as T
from glyphloom.operators import alignment, mixed, parsing, provenance, runs, structure, synthetic

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return T.bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# The same expressions in DuckDB's SQL. Its regular expressions have no look-behind, so those are written otherwise.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SQUEEZE = lambda x: rf"trim(regexp_replace({x}, '{_WS}', ' ', 'g'), ' ')"
_FOLD = lambda x: rf"regexp_replace(translate({x}, {quoted(T.FOLD_FROM)}, {quoted(T.FOLD_TO)}), '\p{{Mn}}+', '', 'g')"
_HIGH = lambda x: rf"length(regexp_replace({x}, '[^\x{{a1}}-\x{{ff}}]', '', 'g'))"
_ONLY = lambda x, c: f"length(regexp_replace({x}, '[^{c}]', '', 'g'))"
_VN = {**codecs.TCVN3, **{k: codecs.TCVN3[v] for k, v in codecs.PDF.items()}}
_TCVN3 = lambda x: f"translate({x}, {quoted(''.join(_VN))}, {quoted(''.join(_VN.values()))})"
_UPPER = lambda x: f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: CASE WHEN length(regexp_replace(l, '[^A-Za-z]', '', 'g')) >= 3 AND NOT regexp_matches(l, '[a-z]') THEN upper(l) ELSE l END), chr(10))"
_MAP = lambda t: "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in t.items()) + "}"
_VNI = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, {quoted(codecs.VNI_PATTERN)}), lambda c: coalesce({_MAP(codecs.VNI_DECODE)}[c], c)), '')"
_RESIDUE = lambda x: rf"length(regexp_replace({x}, '[^\x{{a1}}-\x{{ff}}]|[{codecs.LATIN1_VN}]', '', 'g'))"
_MISREAD = lambda x: f"{_RESIDUE(x)} * 3 + len(regexp_extract_all({x}, '[aeiouyAEIOUY][{codecs.ACCENTED}]'))"


def predictions(docs: DataFrame) -> DataFrame:
    """A made-up parser's output, for lack of real ones: a tenth is missing, others lose diacritics or sentence ends. Its scores say nothing about any parser."""
    d, text = F.col("doc_id"), F.col("text")
    broken = F.when(d % 3 == 0, T.base_letters(text)).when(d % 3 == 1, F.replace(text, F.lit(". "), F.lit(" "))).otherwise(text)
    return docs.filter(d % 10 != 3).select("doc_id", broken.alias("got"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(predictions(docs), "doc_id", "left").select(F.col("doc_id").alias("document"), "got", F.col("text").alias("truth"))


@query(f"SELECT doc_id, md5({_SQUEEZE('nfc_normalize(text)')}) AS text_md5, length({_SQUEEZE('nfc_normalize(text)')}) AS n_chars FROM documents")
def normalise_text(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("t"))
    return out.select("doc_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, md5({_FOLD('text')}) AS text_md5 FROM documents")
def base_letters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.base_letters(F.col("text")).cast("binary")).alias("text_md5"))


@query("SELECT lang, count(*) AS n_documents, sum(length(regexp_replace(text, '[^ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöü\\p{Mn}]', '', 'g'))) AS n_diacritics, sum(length(text)) AS n_chars FROM documents GROUP BY lang")
def diacritic_count_by_lang(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_documents"), F.sum(T.diacritics(t)).alias("n_diacritics"), F.sum(F.length(t)).alias("n_chars"))


@query(rf"SELECT doc_id, len(string_split(regexp_replace({_SQUEEZE('text')}, '([.;:!?]) +', '\1' || chr(1), 'g'), chr(1))) AS n_segments FROM documents")
def segment_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.segments(T.squeezed(F.col("text")))).cast("long").alias("n_segments"))


@query(f"SELECT doc_id, CASE WHEN {_SQUEEZE('text')} = '' THEN 0 ELSE len(string_split({_SQUEEZE('text')}, ' ')) END AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("SELECT lang, count(*) AS n_documents, count(*) FILTER (doc_id % 10 = 3) AS n_failures FROM documents GROUP BY lang")
def truth_pred_failures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.join(predictions(docs), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n_documents"), F.count_if(F.col("got").isNull()).alias("n_failures"))


def _tabular_sql(mark: str) -> str:
    return f"SELECT doc_id, {mark} AS mark, len(l) > 0 AND len(list_filter(l, lambda x: contains(x, {mark}))) / len(l) > 0.8 AS tabular FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {_SQUEEZE('x')} <> '') AS l FROM documents)"


@query(_tabular_sql("chr(9)") + " UNION ALL " + _tabular_sql("'|'"))
def tabular_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = lambda m: docs.select("doc_id", F.lit(m).alias("mark"), T.is_tabular(F.col("text"), m).alias("tabular"))
    return one("\t").unionByName(one("|"))


_FAMILY = rf"CASE WHEN {_HIGH('text')} < 50 THEN NULL WHEN len(regexp_extract_all(text, '[aeiouyAEIOUY][\x{{a1}}-\x{{ff}}]')) / {_HIGH('text')} > 0.35 THEN 'vni' ELSE 'tcvn3' END"


@query(f"SELECT doc_id, {_FAMILY} AS family FROM documents")
def text_family(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", screening.text_family(F.col("text")).alias("family"))


_LEGACY = f"CASE WHEN {_ONLY('text', screening.UNICODE_ONLY)} = 0 AND {_HIGH('text')} < 20 THEN NULL ELSE {_HIGH('text')} > {_ONLY('text', screening.UNICODE_ONLY)} END"
_DOMINATES = f"{_HIGH('text')} > {_ONLY('lower(text)', codecs.ACCENTED + 'đ')}"


@query(f"SELECT doc_id, {_LEGACY} AS is_legacy FROM documents")
def text_is_legacy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", screening.text_is_legacy(F.col("text")).alias("is_legacy"))


@query(f"SELECT doc_id, {_DOMINATES} AS dominates FROM documents")
def legacy_dominates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", screening.legacy_dominates(F.col("text")).alias("dominates"))


_UNMAPPED = lambda x: rf"len(list_distinct(list_filter(string_split(regexp_replace({x}, '[^\x{{a1}}-\x{{ff}}]|[{codecs.LATIN1_VN}]', '', 'g'), ''), lambda c: c <> '')))"


@query(f"""WITH f AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN '.VnTime' WHEN 1 THEN 'VNI-Times' WHEN 2 THEN 'Arial' ELSE 'ABCDEF' END AS font, {_FAMILY} AS family, {_LEGACY} AS legacy, {_DOMINATES} AS dominates FROM documents),
u AS (SELECT *, {_UNMAPPED(_UPPER(_TCVN3('text')))} AS t, {_UNMAPPED(_VNI('text'))} AS v FROM f)
SELECT doc_id, CASE WHEN font <> 'Arial' AND (doc_id % 2 = 1 OR coalesce(legacy, false)) AND dominates AND family IS NOT NULL THEN CASE WHEN t < v THEN 'tcvn3' WHEN v < t THEN 'vni' ELSE family END END AS encoding FROM u""")
def classify_gate(spark, sf_dir):
    font = F.element_at(F.array(*map(F.lit, (".VnTime", "VNI-Times", "Arial", "ABCDEF"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", screening.classify(F.array(font), F.col("text"), F.col("doc_id") % 2 == 0).alias("encoding"))


@query(f"SELECT doc_id, md5(nfc_normalize({_UPPER(_TCVN3('text'))})) AS text_md5, {_RESIDUE('nfc_normalize(' + _UPPER(_TCVN3('text')) + ')')} AS residue FROM documents")
def tcvn3_decode(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", codecs.tcvn3_convert(F.col("text")).alias("t"))
    return out.select("doc_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), codecs.residue(F.col("t")).cast("long").alias("residue"))


@query(f"SELECT doc_id, {_UPPER('text')} <> text AS changed FROM documents")
def uppercase_runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (codecs.upper_runs(F.col("text")) != F.col("text")).alias("changed"))


@query(f"SELECT doc_id, md5(nfc_normalize({_VNI('text')})) AS text_md5, {_RESIDUE('nfc_normalize(' + _VNI('text') + ')')} AS residue FROM documents")
def vni_decode(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", codecs.vni_convert(F.col("text")).alias("t"))
    return out.select("doc_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), codecs.residue(F.col("t")).cast("long").alias("residue"))


_VNI_OUT = "array_to_string(list_transform(string_split(text, ''), lambda c: coalesce(" + _MAP(codecs.VNI_ENCODE) + "[c], c)), '')"
_ENCODABLE = rf"NOT regexp_matches(translate(text, {quoted(''.join(codecs.VNI_ENCODE))}, ''), '[^\P{{L}}\x00-\x7f]')"


@query(f"SELECT doc_id, md5({_VNI_OUT}) AS text_md5, {_ENCODABLE} AS encodable FROM documents")
def vni_encode(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(codecs.vni_encode(t).cast("binary")).alias("text_md5"), codecs.vni_encodable(t).alias("encodable"))


@query(f"WITH e AS (SELECT doc_id, text, {_VNI_OUT} AS v FROM documents) SELECT doc_id, {_VNI('v')} = text AS same FROM e")
def vni_roundtrip(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (codecs.vni_decode(codecs.vni_encode(t)) == t).alias("same"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, {_HIGH('line')} AS high, {_MISREAD(_UPPER(_TCVN3('line')))} AS t, {_MISREAD(_VNI('line'))} AS v FROM l)
SELECT doc_id, count(*) FILTER (high > 0 AND t < v) AS tcvn3, count(*) FILTER (high > 0 AND v < t) AS vni, count(*) FILTER (high = 0 OR t = v) AS inherited FROM s GROUP BY doc_id""")
def mixed_line_state(spark, sf_dir):
    return mixed.decode(table(spark, sf_dir, "documents")).select("doc_id", "tcvn3", "vni", "inherited")


_TURNS = "SELECT conv_id, list((turn * 7 + conv_id) % 5 ORDER BY turn) AS l, count(*) AS n FROM conversations GROUP BY conv_id"


def _labelled(spark, sf_dir):
    """Conversations as documents with planted labels, one per turn."""
    c = table(spark, sf_dir, "conversations").withColumn("label", F.concat(F.lit("Đoạn số "), ((F.col("turn") * 7 + F.col("conv_id")) % 5).cast("string"), F.lit(". "), F.coalesce("text", F.lit(""))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "label"))), lambda x: x["label"]), "\n")
    return c.groupBy("conv_id").agg(text.alias("text"), F.count("*").alias("n"))


@query(f"WITH t AS ({_TURNS}) SELECT conv_id, CASE WHEN len(l) < 2 THEN 1.0 ELSE round(len(list_filter(range(1, len(l)), lambda i: l[i + 1] > l[i])) / (len(l) - 1), 4) END AS order_score FROM t")
def label_order(spark, sf_dir):
    return _labelled(spark, sf_dir).select("conv_id", structure.order(structure.labels(F.col("text"))).alias("order_score"))


@query(f"WITH t AS ({_TURNS}) SELECT conv_id, round(len(list_distinct(l)) / n, 4) AS completeness FROM t")
def label_completeness(spark, sf_dir):
    return _labelled(spark, sf_dir).select("conv_id", structure.completeness(structure.labels(F.col("text")), F.col("n")).alias("completeness"))


@query(r"""WITH h AS (SELECT page_id, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS t FROM pages) SELECT page_id, CASE WHEN t = '' THEN 1.0 WHEN page_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS recall FROM h""")
def heading_recall(spark, sf_dir):
    title = F.trim(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1))
    expected = F.when(title == "", F.array().cast("array<string>")).otherwise(F.array(title))
    text = F.concat(F.when(F.col("page_id") % 2 == 0, "## ").otherwise(""), title, F.lit("\n\nbody"))
    return table(spark, sf_dir, "pages").select("page_id", structure.heading_recall(text, expected).alias("recall"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}]).*?(^|[^\p{L}\p{N}])of($|[^\p{L}\p{N}])') OR regexp_matches(l, '(^|[^\p{L}\p{N}])the[^\p{L}\p{N}]of($|[^\p{L}\p{N}])'))) > 0 AS present FROM documents")
def row_present(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", structure.row_present(F.col("text"), ["the", "of"]).alias("present"))


@query()
def accuracies(spark, sf_dir):
    return alignment.scores(_both(spark, sf_dir))


@query()
def score_summary(spark, sf_dir):
    truth = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), "lang")
    return alignment.summary(truth, alignment.scores(_both(spark, sf_dir)), "lang")


_SCORED = "SELECT doc_id AS document, lang, CASE WHEN doc_id % 10 <> 3 THEN (doc_id % 97) / 97.0::DOUBLE END AS acc, CASE WHEN doc_id % 10 <> 3 THEN n_chars END AS w FROM documents"


@query(f"SELECT lang, count(acc) AS n_documents, count(*) FILTER (acc IS NULL) AS n_failures, coalesce(round(sum(acc * w) / coalesce(nullif(sum(w), 0), 1), 4), 0.0) AS char_accuracy FROM ({_SCORED}) GROUP BY lang")
def score_weighted_mean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    acc = (F.col("doc_id") % 97) / F.lit(97.0)
    scored = docs.filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("document"), acc.alias("char_accuracy"), acc.alias("diacritic_accuracy"), acc.alias("syllable_accuracy"), F.col("n_chars").alias("truth_chars"), F.lit(0).alias("diacritic_positions"))
    return alignment.summary(docs.select(F.col("doc_id").alias("document"), "lang"), scored, "lang").select("lang", "n_documents", "n_failures", F.round("char_accuracy", 4).alias("char_accuracy"))


@query("""WITH s AS (SELECT DISTINCT source AS file FROM documents), l AS (SELECT file, CASE WHEN length(file) % 2 = 0 THEN 'pending' ELSE 'ready' END AS status FROM s WHERE file <> 'src3' UNION ALL SELECT 'gone', 'ready'), f AS (SELECT file FROM s WHERE file <> 'src5')
SELECT file, 'no entry' AS problem FROM f WHERE file NOT IN (SELECT file FROM l) UNION ALL SELECT file, 'no file' FROM l WHERE file NOT IN (SELECT file FROM f) UNION ALL SELECT file, 'no transcript' FROM l WHERE status = 'ready' AND file NOT IN (SELECT file FROM s WHERE file <> 'src7' AND file <> 'src15')""")
def provenance_violations(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("file")).distinct()
    gone = spark.createDataFrame([("gone", "ready")], "file string, status string")
    ledger = s.filter("file <> 'src3'").withColumn("status", F.when(F.length("file") % 2 == 0, "pending").otherwise("ready")).unionByName(gone)
    return provenance.violations(ledger, s.filter("file <> 'src5'").withColumn("path", F.concat(F.lit("x/"), "file")), s.filter("file not in ('src7', 'src15')"))


@query("""WITH k AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS urlkey FROM pages), f AS (SELECT urlkey, min(page_id) AS page_id FROM k GROUP BY urlkey)
SELECT urlkey, page_id FROM f WHERE urlkey NOT IN (SELECT urlkey FROM k WHERE page_id % 11 = 0)""")
def dedupe_candidates(spark, sf_dir):
    keyed = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("urlkey"))
    return provenance.fresh(keyed, keyed.filter("page_id % 11 = 0"), "urlkey", "page_id")


@query("SELECT doc_id AS document, lang FROM documents WHERE doc_id % 10 = 3")
def score_failures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return alignment.failures(docs.select(F.col("doc_id").alias("document"), "lang"), predictions(docs).withColumnRenamed("doc_id", "document"))


def _toy(text):
    """Stands for a parser: gives the lines as chunks, and fails on one text in seven by its length."""
    if len(text) % 7 == 0:
        raise ValueError("seven")
    return text, text.split("\n")


@query("SELECT doc_id AS document, CASE WHEN length(text) % 7 <> 0 THEN md5(text) END AS text_md5, CASE WHEN length(text) % 7 <> 0 THEN len(string_split(text, chr(10))) END AS n_chunks, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: seven' END AS error FROM documents")
def parser_driver(spark, sf_dir):
    out = parsing.parsed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.col("text").alias("content")), _toy)
    return out.select("document", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.when(F.col("error").isNull(), F.size("chunks")).cast("long").alias("n_chunks"), "error")


def _structured(spark, sf_dir):
    """Conversations as documents read in turns; every seventh isn't read. Their labels 0 and 1 stand for a table's rows, 0 for its header."""
    c = _labelled(spark, sf_dir).withColumnRenamed("conv_id", "document")
    manifest = c.select("document", F.col("n").cast("int").alias("paragraphs"), F.array(F.lit("Đầu")).alias("headings"), F.expr("array(array('số 0.'), array('số 0.'), array('số', '1.'))").alias("table"))
    text = F.concat(F.when(F.col("document") % 2 == 0, "# Đầu\n").otherwise(""), "text")
    return c.filter("document % 7 <> 3").select("document", text.alias("text"), F.split("text", "\n").alias("chunks")), manifest


_STRUCTURE = f"""SELECT conv_id AS document, CASE WHEN len(l) < 2 THEN 1.0 ELSE round(len(list_filter(range(1, len(l)), lambda i: l[i + 1] > l[i])) / (len(l) - 1), 4) END AS "order", round(len(list_distinct(l)) / n, 4) AS completeness,
CASE WHEN conv_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS headings, (CAST(list_contains(l, 0) AS INT) + CAST(list_contains(l, 1) AS INT)) / 2 AS rows_recovered,
len(list_filter(l, lambda x: x < 2)) AS chunks_with_rows, len(list_filter(l, lambda x: x = 1)) AS chunks_missing_header, NOT list_contains(l, 1) AS header_always_present FROM ({_TURNS}) WHERE conv_id % 7 <> 3"""


@query(_STRUCTURE)
def structure_documents(spark, sf_dir):
    out = structure.document_scores(*_structured(spark, sf_dir)).drop("headings_missing", "labels_read")
    return out.withColumns({c: F.col(c).cast("long") for c in ("chunks_with_rows", "chunks_missing_header")})


@query(f'SELECT count(*) AS n_documents, coalesce(round(avg("order"), 4), 0.0) AS "order", coalesce(round(avg(completeness), 4), 0.0) AS completeness, coalesce(round(avg(headings), 4), 0.0) AS headings, count(*) FILTER (NOT header_always_present) AS documents_with_orphaned_table_rows FROM ({_STRUCTURE})')
def structure_means(spark, sf_dir):
    return structure.means(structure.document_scores(*_structured(spark, sf_dir)))


@query("SELECT DISTINCT conv_id AS document FROM conversations WHERE conv_id % 7 = 3")
def structure_not_scored(spark, sf_dir):
    read, manifest = _structured(spark, sf_dir)
    return structure.not_scored(manifest, read)


_VERDICTS = """SELECT document, CASE WHEN c < 40 AND i >= 0.6 THEN 'scan' WHEN c >= 40 AND i < 0.6 THEN 'digital' ELSE 'mixed' END AS kind, pages, round(c, 1) AS chars_per_page, round(i, 2) AS image_pages, pages > 12 AS sampled FROM (
SELECT conv_id AS document, count(*) AS pages, avg(length(coalesce(text, '')) % 90) FILTER (turn - first < 12) AS c, avg(CASE WHEN (conv_id + turn) % 3 > 0 THEN 1.0 ELSE 0.0 END) FILTER (turn - first < 12) AS i
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) GROUP BY conv_id)"""


def _verdicts(spark, sf_dir):
    """Conversations as scanned documents, a page a turn."""
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    return runs.verdicts(c.join(first, "conv_id").select(F.col("conv_id").alias("document"), (F.col("turn") - F.col("first")).alias("page_no"), (F.length(F.coalesce("text", F.lit(""))) % 90).alias("chars"), ((F.col("conv_id") + F.col("turn")) % 3).alias("images")))


@query(_VERDICTS)
def scan_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(f"SELECT kind, count(*) AS n FROM ({_VERDICTS}) GROUP BY kind")
def verdict_counts(spark, sf_dir):
    return runs.counts(_verdicts(spark, sf_dir), "kind")


@query("SELECT count(*) AS n, count(*) FILTER (page_id % 9 = 4) AS throttled, count(*) FILTER (page_id % 9 = 4) / count(*) AS throttled_share, count(*) FILTER (page_id % 9 = 5) AS unfetched, count(*) FILTER (page_id % 9 = 5) / count(*) AS unfetched_share FROM pages")
def fetch_shares(spark, sf_dir):
    kind = F.when(F.col("page_id") % 9 == 4, "throttled").when(F.col("page_id") % 9 == 5, "unfetched").otherwise("scan")
    return runs.shares(table(spark, sf_dir, "pages").select(kind.alias("kind")))


@query(f"SELECT source, count(*) FILTER (doc_id % 8 <> 1) AS checked, count(*) FILTER (doc_id % 8 = 1) AS failed, count(*) FILTER (doc_id % 8 <> 1 AND {_FAMILY} IS NOT NULL) AS hits, count(*) FILTER (doc_id % 8 <> 1 AND {_FAMILY} IS NOT NULL) / nullif(count(*) FILTER (doc_id % 8 <> 1), 0) AS yield FROM documents GROUP BY source")
def screening_yield(spark, sf_dir):
    return runs.yields(table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 8 != 1).alias("fetched"), screening.text_family(F.col("text")).alias("encoding")), "source")


@query("SELECT count(*) AS entries, count(*) FILTER (doc_id % 4 = 0) AS ready, count(*) FILTER (doc_id % 4 = 1) AS pending FROM documents")
def provenance_counts(spark, sf_dir):
    status = F.when(F.col("doc_id") % 4 == 0, "ready").when(F.col("doc_id") % 4 == 1, "pending").otherwise("rejected")
    return provenance.status_counts(table(spark, sf_dir, "documents").select(status.alias("status")))


# Lines of transcripts as VNI: the first 120 that aren't blank, the first letter that VNI can't write, and whether the line comes back.
_VNI_LINES = f"""SELECT document, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id AS document, list_filter(string_split(nfc_normalize(text), chr(10)), lambda x: {_SQUEEZE('x')} <> '')[1:{synthetic.LINES}] AS l FROM documents)"""
_VNI_KEPT = rf"""SELECT *, nullif(regexp_extract(translate(text, {quoted(''.join(codecs.VNI_ENCODE))}, ''), '[^\P{{L}}\x00-\x7f]'), '') AS gap, nfc_normalize({_VNI('surface')}) = text AS same FROM (SELECT *, {_VNI_OUT} AS surface FROM ({_VNI_LINES}))"""


def _vni_lines(spark, sf_dir):
    return synthetic.vni_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), T.nfc(F.col("text")).alias("text")))


@query(f"SELECT document, md5(string_agg(surface, chr(10) ORDER BY line_no)) AS surface_md5, md5(string_agg(text, chr(10) ORDER BY line_no) || chr(10)) AS truth_md5 FROM ({_VNI_KEPT}) WHERE gap IS NULL AND same GROUP BY document")
def synthetic_vni(spark, sf_dir):
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")
    return synthetic.vni_corpus(_vni_lines(spark, sf_dir)).select("document", digest("surface"), digest("truth"))


@query(f"SELECT gap AS letter, count(*) AS n FROM ({_VNI_KEPT}) WHERE NOT (gap IS NULL AND same) GROUP BY gap")
def synthetic_dropped(spark, sf_dir):
    return synthetic.dropped(_vni_lines(spark, sf_dir))
