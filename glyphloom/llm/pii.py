"""Personal data: patterns find the protected entities, information content finds the terms that give them away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each is
an occurrence of an entity (its value without case and separators). For the
words of a text with an entity the corpus says how much they tell of it: with N
documents, n(t) of which hold term t, n(e) entity e and n(t, e) both, the
pointwise mutual information log(n(t,e) N / (n(t) n(e))) is set
against the entity's own information log(N / n(e)). A term that discloses a
share of GENERALISE or more is replaced by its class, one that discloses REMOVE
or more is removed, at all its places in the text. The share alone decides, at
any n(t, e): n(t) over all documents is the background, so for an entity seen
once only rare terms pass. All counts are of rows, so copies count alike in each.

Only DataFrame operations are used: positions come from splitting a text by the
pattern that also lists its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import staged, table

# Kinds in their order, a literal that a text must hold, and patterns. Possessive quantifiers and the look-behind only keep
# long runs linear: \G lets a match start where the last one ended, as plain search would.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A term is a whole word of letters, compared in lower case.
TERM = r"[\p{L}]++"
GENERALISE, REMOVE = 0.8, 0.95
SPAN = "array<struct<s:int,kind:int,e:int,v:string>>"


def located(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Structs s, kind, e, v of all matches (whose string keep accepts), leftmost and non-overlapping, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        more = F.array_append(acc["out"], F.struct(s.alias("s"), F.lit(kind).alias("kind"), e.alias("e"), x["m"].alias("v")))
        return F.struct(e.alias("at"), (more if keep is None else F.when(keep(x["m"]), more).otherwise(acc["out"])).alias("out"))

    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _luhn(v: Column) -> Column:
    digits = F.reverse(F.regexp_replace(v, "[^0-9]", ""))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _digits(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    """All valid base spans of a text, by start, then kind. An empty text has none."""
    none = F.array().cast(SPAN)
    has = lambda c, spans: F.when(c, spans).otherwise(none)
    email = has(F.contains(text, F.lit("@")), located(text, EMAIL, 0))
    octets = lambda v: F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    ip = has(F.contains(text, F.lit(".")) & text.rlike(r"[0-9]\.[0-9]"), F.filter(located(text, IP, 1), lambda x: F.forall(octets(x["v"]), lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))))
    card = has(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.filter(located(text, CARD, 2), lambda x: F.when(_digits(x["v"]).between(12, 19), _luhn(x["v"])).otherwise(False)))
    phone = has(F.contains(text, F.lit("+")), F.filter(located(text, PHONE, 3), lambda x: _digits(x["v"]).between(9, 15)))
    return F.array_sort(F.concat(email, ip, card, phone))


def _entities(spans: Column) -> Column:
    """The entities of base spans, each once."""
    value = lambda x: F.when(x["kind"] == 0, F.lower(x["v"])).when(x["kind"] == 1, x["v"]).otherwise(F.regexp_replace(x["v"], "[^0-9]", ""))
    return F.array_distinct(F.transform(spans, lambda x: F.concat_ws(":", x["kind"].cast("string"), value(x))))


def _terms(text: Column) -> Column:
    """The terms of a text, each once."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def disclosures(docs: DataFrame, held: DataFrame) -> DataFrame:
    """row, t and share: the terms of a row that disclose one of its entities, and the largest share. Counts cover every row.

    docs: text of all rows. held: row (a number of its own), text and entities of the rows that hold any.
    """
    total = docs.count()
    owned = held.select("row", F.explode("entities").alias("entity"))
    entity = owned.groupBy("entity").agg(F.count("*").alias("n_e"))
    owned = staged(owned.join(entity, "entity"), "owned")
    # As n(t,e) <= min(n(t), n(e)), a share of GENERALISE takes n(t) <= N^(1 - GENERALISE) n(e)^GENERALISE; the margin is for rounding.
    bound = lambda n_e: 1.000001 * float(total) ** (1 - GENERALISE) * F.pow(n_e, F.lit(GENERALISE))
    # Words are counted in each task before they are shuffled; only then are the wanted ones picked.
    holds = docs.select(F.explode(_terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    most = owned.agg(F.max("n_e")).first()[0] or 0
    rare = holds.filter(F.col("n_t") <= bound(F.lit(most)))
    words = held.select("row", F.explode(_terms(F.col("text"))).alias("t"))
    both = words.join(rare, "t").join(owned, "row").filter(F.col("n_t") <= bound(F.col("n_e")))
    both = staged(both.select("row", "entity", "t", "n_t", "n_e"), "pairs")
    told = both.groupBy("entity", "t").agg(F.count("*").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    pmi = F.log(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    own = F.log(F.lit(float(total)) / F.col("n_e"))
    told = told.withColumn("share", F.when(own > 0, pmi / own).otherwise(0.0)).filter(F.col("share") >= GENERALISE).select("entity", "t", "share")
    return both.select("row", "entity", "t").join(told, ["entity", "t"]).groupBy("row", "t").agg(F.max("share").alias("share"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, spans (structs s, kind, e, v; base ones and terms) and text with the spans generalised or removed, for every row.

    Null text counts as empty: no spans, empty text. Base spans become <KIND>; terms become <TERM>, or go if they disclose
    REMOVE or more. Only words of a row with an entity are terms, so a row without entities stays as it is.
    Overlapping spans are replaced as one. Null or repeated doc_ids are fine.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = plain.withColumn("base", base_spans(F.col("text")))
    # Rows with entities, each under a number of its own, are few next to the texts; only they go on to the terms.
    held = staged(found.filter(F.size("base") > 0).withColumn("entities", _entities(F.col("base"))).withColumn("row", F.monotonically_increasing_id()), "entities")
    told = disclosures(plain.select("text"), held)
    flagged = told.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("t", F.when(F.col("share") >= REMOVE, "").otherwise("<TERM>")))).alias("told"))  # at most the words of one row
    places = located(F.col("text"), TERM, 4, lambda w: F.map_contains_key("told", F.lower(w)))
    outside = F.filter(places, lambda w: ~F.exists("base", lambda x: (x["s"] < w["e"]) & (w["s"] < x["e"])))
    terms = F.transform(outside, lambda w: w.withField("v", F.element_at("told", F.lower(w["v"]))))
    ready = held.join(flagged, "row", "left").withColumn("terms", F.when(F.col("told").isNotNull(), terms).otherwise(F.array().cast(SPAN)))
    ready = ready.select("doc_id", "text", F.array_sort(F.concat("base", "terms")).alias("spans"))
    rest = found.filter(F.size("base") == 0).select("doc_id", "text", F.array().cast(SPAN).alias("spans"))
    return ready.withColumn("text", _replaced(F.col("text"), F.col("spans"))).unionByName(rest).select("doc_id", "spans", "text")


def _replaced(text: Column, spans: Column) -> Column:
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        put = F.when(x["kind"] == 4, x["v"]).otherwise(F.get(names, x["kind"]))
        piece = F.when(x["s"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), put)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from those of sanitise()."""
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    of = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    return found.select("doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(told(F.filter("spans", lambda x: x["kind"] < 4)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), of(4).alias("n_term"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its personal data; null text counts as empty."""
    return digest(sanitise(table(spark, sf_dir, "documents")))
