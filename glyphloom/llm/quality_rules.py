"""Quality rules: fixed limits, then robust multivariate outliers.

Each text gives five counts (the base). They are turned into a vector of four
logarithmic or relative statistics. For every language and source the
minimum-covariance-determinant estimate of centre and scatter is found over all
rows: from two starts (medians with spreads, and the plain moments) concentration
steps, each of which keeps the three quarters of the rows nearest to the last
centre and estimates anew, until the determinants settle; the start with the
smaller determinant stands. A row is rejected if its squared Mahalanobis distance
exceeds CUT.

A group's moments are pooled with PRIOR rows of its language's, and those with
PRIOR rows of all, so a verdict changes smoothly with a group's size. Every step
is one pass over the slim table of vectors; estimates are a table with a row per
group, joined back by group. Distances are counted in fixed bins, so that no
group, however large, meets in one task. Values are integers, so sums don't depend
on order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import BROADCAST_BYTES, dropped, rowed, sized, skew_join, small_batches, staged, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a group that the estimate rests on, steps at most, change of the mean logarithm of the determinants that ends them, rows that the wider estimate counts for in a group's own.
COVERAGE, STEPS, SETTLED, PRIOR = 0.75, 8, 1e-3, 200
#: The trimmed covariance of 4 normal statistics at this coverage is so much of the whole one.
TRIMMED = 0.61
#: Squared distance beyond which a row goes: the point that a chi-square with 4 degrees of freedom exceeds with chance TAIL.
TAIL = 1e-5
CUT = 28.473255
#: A statistic is stored in units of 1 / UNIT. Least standard deviation of each one, for groups in which most rows have the same value.
UNIT = 1000
FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
FLOOR = (0.10, 0.35, 0.10, 0.10)
BINS_PER_E = 16


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; all 0 for an empty one."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line and line.strip(SPACES):
            seen.add(line)
    repeat = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        k = len(ids)
        pair = np.unique(w[:-1] * k + w[1:], return_inverse=True)[1]
        _, of, times = np.unique(pair[:-1].astype(np.int64) * k + w[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[of] > 1)
        hit = np.zeros(n, bool)
        for d in range(3):
            hit[at + d] = True
        repeat = int(hit.sum())
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_key (a hash of these and the text) and the five counts of every row; null texts count as empty."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("row_key", F.xxhash64("doc_id", "lang", "source", "text"))

    def run(batches):
        for pdf in batches:
            made = np.array([counts(x) for x in pdf["text"]], np.int64).reshape(-1, 5)
            out = pdf[["doc_id", "lang", "source", "row_key"]].copy()
            for i, c in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
                out[c] = made[:, i]
            yield out.astype({"doc_id": "Int64"})

    return keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "row_key", "text").mapInPandas(run, "doc_id long, lang string, source string, row_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")


def _vector(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    made = {
        "word_length": F.log((F.col("word_chars") + 1) / n),
        "symbols": F.log1p(20 * F.col("n_symbols") / n),
        "dup_lines": F.log1p(20 * F.col("n_dup_lines") / n),
        "repeats": F.col("n_repeat_words") / n * 2,
    }
    return df.withColumns({f"x_{k}": F.round(v * UNIT).cast("long") for k, v in made.items()})


STARTS = 2
_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
#: Names of a start's moments: rows, sums, sums of products.
_NAMES = lambda k: [f"m{k}_n", *[f"m{k}_s{i}" for i in range(len(FEATURES))], *[f"m{k}_p{i}{j}" for i, j in _PAIRS]]


def _moments(df: DataFrame, keep: list[F.Column]) -> DataFrame:
    """Per group and start: rows, sums and sums of products of the rows kept."""
    xs, out = [F.col(f"x_{k}") for k in FEATURES], []
    for k, own in enumerate(keep):
        values = [F.lit(1), *xs, *[xs[i] * xs[j] for i, j in _PAIRS]]
        out += [F.coalesce(F.sum(F.when(own, v)), F.lit(0)).cast("double").alias(n) for n, v in zip(_NAMES(k), values, strict=True)]
    return df.groupBy("grp", "grp_lang").agg(*out)


def _starts(good: DataFrame) -> DataFrame:
    """Moments of both starts: medians with the spread between quartiles, and the plain ones."""
    quarts = [F.percentile(f"x_{k}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, k in enumerate(FEATURES)]
    n, mid = F.col("n").cast("double"), [F.col(f"q{i}")[1] for i in range(len(FEATURES))]
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.35, F.lit(f * UNIT)) for i, f in enumerate(FLOOR)]
    values = [n, *[n * m for m in mid], *[n * (mid[i] * mid[j] + (spread[i] * spread[i] if i == j else 0.0)) for i, j in _PAIRS]]
    robust = good.groupBy("grp", "grp_lang").agg(F.count("*").alias("n"), *quarts).select("grp", "grp_lang", *[v.alias(c) for c, v in zip(_NAMES(0), values, strict=True)])
    plain = _moments(good, [F.lit(False), F.lit(True)]).select("grp", *_NAMES(1))
    return robust.join(plain, "grp")


def matrices(means: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, inverse scatters and logarithms of the scatters' determinants, of rows of mean values and mean products; share: what trimming has left of the scatter."""
    d = len(FEATURES)
    centre, scatter = means[:, :d] / UNIT, np.zeros((len(means), d, d))
    for c, (i, j) in enumerate(_PAIRS):
        scatter[:, i, j] = scatter[:, j, i] = means[:, d + c] / UNIT**2 - centre[:, i] * centre[:, j]
    scatter = scatter / share + np.diag(np.square(FLOOR))
    return centre, np.linalg.inv(scatter), np.linalg.slogdet(scatter)[1]


def _estimates(moments: DataFrame, share: float) -> DataFrame:
    """grp, and for each start est (centre, then inverse scatter) and det (logarithm of the determinant), a row per group."""
    moments = staged(moments, "moments")
    names = [n for k in range(STARTS) for n in _NAMES(k)]
    whole = moments.agg(*[F.sum(n).alias(n) for n in names]).first()
    langs = moments.groupBy("grp_lang").agg(*[F.sum(n).alias(f"l_{n}") for n in names])
    pooled = []
    for k in range(STARTS):
        n, *rest = _NAMES(k)
        for c in rest:
            lang = (F.col(f"l_{c}") + PRIOR * (whole[c] or 0.0) / (whole[n] or 1.0)) / (F.col(f"l_{n}") + PRIOR)
            pooled.append(((F.col(c) + PRIOR * lang) / (F.col(n) + PRIOR)).alias(c))

    def run(batches):
        for pdf in batches:
            out = pdf[["grp"]].copy()
            for k in range(STARTS):
                centre, inverse, det = matrices(pdf[_NAMES(k)[1:]].to_numpy(float), share)
                out[f"est{k}"] = list(np.concatenate([centre, inverse.reshape(len(pdf), -1)], axis=1))
                out[f"det{k}"] = det
            yield out

    kinds = ", ".join(f"est{k} array<double>, det{k} double" for k in range(STARTS))
    out = staged(moments.join(langs, "grp_lang").select("grp", *pooled).mapInPandas(run, f"grp string, {kinds}"), "estimates")
    dropped(moments)
    return out


def _squared(est: str) -> F.Column:
    """The squared distance of a row from the estimate in this column."""
    d, total = len(FEATURES), F.lit(0.0)
    diff = [(F.col(f"x_{k}") / UNIT - F.col(est)[i]) for i, k in enumerate(FEATURES)]
    for i in range(d):
        for j in range(d):
            total = total + diff[i] * diff[j] * F.col(est)[d + i * d + j]
    return total


def _of_group(df: DataFrame, groups: DataFrame, sizes: DataFrame, total: int, row_bytes: int) -> DataFrame:
    """df with the columns of its group, a row each: by broadcast while groups are small, else in a skew-safe join."""
    if groups.limit(BROADCAST_BYTES // row_bytes + 1).count() <= BROADCAST_BYTES // row_bytes:
        return df.join(F.broadcast(groups), "grp", "left")
    return skew_join(df, groups.join(sizes, "grp"), "grp", "size", total).drop("size")


def distances(stats: DataFrame) -> DataFrame:
    """stats (with grp, grp_lang, the vector and base_failed) and distance, the squared one; null in a group without rows that pass the base."""
    good = stats.filter(~F.col("base_failed"))
    sizes = staged(stats.groupBy("grp").agg(F.count("*").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    est, before = _estimates(_starts(good), 1.0), None
    for _ in range(STEPS):
        near = _of_group(good, est, sizes, total, 600)
        near = near.select("grp", "grp_lang", *[f"x_{k}" for k in FEATURES], *[F.floor(F.log(_squared(f"est{k}") + 1e-6) * BINS_PER_E).cast("int").alias(f"bin{k}") for k in range(STARTS)])
        bounds = staged(near.groupBy("grp").agg(*[F.expr(f"percentile_disc({COVERAGE}) within group (order by bin{k})").cast("int").alias(f"most{k}") for k in range(STARTS)]), "bounds")
        now = _estimates(_moments(_of_group(near, bounds, sizes, total, 100), [F.col(f"bin{k}") <= F.col(f"most{k}") for k in range(STARTS)]), TRIMMED)
        dropped(est, bounds)
        est, after = now, now.agg(*[F.avg(f"det{k}") for k in range(STARTS)]).first()
        if after[0] is None or before is not None and max(abs(a - b) for a, b in zip(after, before, strict=True)) < SETTLED:
            break
        before = after
    best = est.select("grp", F.when(F.col("det1") < F.col("det0"), F.col("est1")).otherwise(F.col("est0")).alias("est"))
    return _of_group(stats, best, sizes, total, 300).withColumn("distance", _squared("est")).drop("est")


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, row_key of every row of docs.

    Null or empty text: all counts 0, base_failed true. Null language or source: a group of its own.
    Every language and source has its own estimate, drawn towards its language's, and that towards the one of
    all rows, the more the fewer rows it has. A statistic that is constant in a group has the scatter of FLOOR. distance is
    null only in groups in which no row passes the base. Equal rows get equal verdicts; an empty table gives an empty
    result. Texts of any length count whole. Columns other than doc_id, text, lang and source play no part.
    """
    stats = _vector(staged(statistics(docs), "quality"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lang = F.coalesce("lang", F.lit("\0"))
    stats = stats.withColumn("base_failed", failed).withColumn("grp_lang", lang).withColumn("grp", F.concat_ws("\x01", lang, F.coalesce("source", F.lit("\0"))))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return distances(stats).select(*columns, (~F.col("base_failed") & (F.col("distance") <= CUT)).alias("kept"), "distance", "row_key").fillna({"kept": False})


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns. Rows equal in all that counts share a row_key and a verdict."""
    gone = staged(rules(docs).filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct(), "gone")
    rows = rowed(docs, docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["doc_id"], docs["lang"].cast("string"), docs["source"].cast("string"), F.coalesce(docs["text"], F.lit(""))).alias("key"))
    return rows.join(sized(gone, 80), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its counts and verdict; null text counts as empty."""
    return rules(table(spark, sf_dir, "documents"))
