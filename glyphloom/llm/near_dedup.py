"""MinHash near-deduplication with odd sketches.

A document is its set of word shingles. Documents with the same set are one
node from the start. Nodes get SAMPLES MinHash values, BANDS bands of ROWS of
them; nodes that share a band are candidates. The samples are also folded into
an odd sketch, a bitmap of parities: the bits in which two sketches differ tell
how many samples differ. A second odd sketch, of the set itself, tells the size
of the sets' difference. Candidates that either puts far below the threshold go
without their sets being fetched; the others are confirmed on their full sets.

Links only have to give the right components, so a bucket's pairs are not all
made. In a few rounds each node of a bucket with several components tries one
centre, the closest of those that its buckets draw and that it has not tried, and
components merge along confirmed links. Then, for buckets that still hold several
components, each member outside the bucket's main component is tried against all
members of other components, in the least of the bands that both share. So no pair
that shares a band is left out, unless both are in one component already, and none
is made twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import BROADCAST_BYTES, dropped, rowed, sized, skew_join, small_batches, staged, staged_skew_join, table

#: A pair of similarity 0.8 shares no band with a chance of (1 - 0.8**4)**28 = 4e-7.
BANDS, ROWS = 28, 4
SAMPLES = BANDS * ROWS
#: Bits of the odd sketch of the samples. Those of a pair of similarity s differ in about BITS / 2 * (1 - exp(-4 * (1 - s) * SAMPLES / BITS))
#: bits: 41 at 0.8. MOST is over six deviations above, so it costs no true pair; unrelated pairs differ in 150.
BITS, MOST = 512, 88
#: Bits of the odd sketch of the set, and deviations above the expected count that a pair at the threshold may differ by.
SET_BITS, SIGMAS = 1024, 6
#: Rounds in which nodes try one centre each, at most; they end before when fewer than one try in PAYS, or links for fewer than one node in GAIN,
#: are found. The last step takes what they leave.
ROUNDS, PAYS, GAIN = 8, 20, 100
#: Edges that the driver joins to components itself, in 16 bytes each; more than that are joined in shuffles, each step of which costs the driver plans and jobs.
HERE = 1 << 17
PERCENT = 80
#: Bytes of the words whose hashes a task keeps; documents that are worked on at a time.
KNOWN_BYTES, PART = 32 << 20, 64
_SEED = np.random.default_rng(20)
_MUL = (_SEED.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _SEED.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class Shingler:
    """Shingle sets as sorted arrays of 64-bit hashes. Keeps hashes of words, up to KNOWN_BYTES."""

    def __init__(self, width: int = 2) -> None:
        self.width, self.known, self.held = width, {}, 0

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct shingles: sequences of `width` words, or all words if there are fewer; none without words. A-Z count as a-z."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
            self.held += len(w) + 150
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * _K1
            out ^= out >> np.uint64(29)
        if self.held > KNOWN_BYTES:
            known.clear()
            self.held = 0
        out = out * _K2
        out ^= out >> np.uint64(32)
        return np.unique(out)


def signature(shingles: np.ndarray) -> tuple[list[int], bytes]:
    """The bands' hashes and the two odd sketches, one after the other, of a non-empty set."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, (shingles[None, i : i + 512] * _MUL[:, None] + _ADD[:, None]).min(1), out=low)
    mixed = (low ^ (low >> np.uint64(31))) * _K3
    bands = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        bands = (bands ^ mixed.reshape(BANDS, ROWS)[:, r]) * _K1
        bands ^= bands >> np.uint64(30)
    bands = (bands + np.arange(BANDS, dtype=np.uint64)) * _K2  # a band's hash tells its number
    bit = ((mixed + np.arange(SAMPLES, dtype=np.uint64)) * _K1) >> np.uint64(64 - 9)
    sketch = np.packbits(np.bincount(bit.astype(np.int64), minlength=BITS) & 1)
    whole = np.packbits(np.bincount(((shingles * _K3) >> np.uint64(64 - 10)).astype(np.int64), minlength=SET_BITS) & 1)
    return bands.view(np.int64).tolist(), np.concatenate([sketch, whole]).tobytes()


def _parts(batches):
    """The batches in parts of PART rows: a set takes several times the room of its text."""
    for pdf in batches:
        for at in range(0, len(pdf), PART):
            yield pdf.iloc[at : at + PART]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), own (digest of the set), bands and sketch of every row of docs."""
    def run(batches):
        shingler = Shingler(width)
        for pdf in _parts(batches):
            out = {"doc_id": pdf["doc_id"].astype("Int64"), "n": [], "own": [], "bands": [], "sketch": []}
            for text in pdf["text"]:
                s = shingler(text if isinstance(text, str) else "")
                bands, sketch = signature(s) if len(s) else ([], [])
                out["n"].append(len(s))
                out["own"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                out["bands"].append(bands)
                out["sketch"].append(np.frombuffer(sketch, ">i8").tolist() if len(s) else [])
            yield pd.DataFrame(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n long, own binary, bands array<long>, sketch array<long>")


def _differ(a: str, b: str, first: int, last: int) -> F.Column:
    """In how many bits the sketches' words from first to last differ."""
    total = F.lit(0)
    for i in range(first, last):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def _bits(a: str, b: str) -> tuple[F.Column, F.Column, F.Column]:
    """In how many bits the samples' sketches differ, in how many those of the sets do, and in how many of these a pair that may be linked can.

    Sets at the threshold differ in most = (|A| + |B|) (1 - s) / (1 + s) shingles at most. Their sketches can't differ in
    more bits than that, and hardly in more than expected plus SIGMAS deviations.
    """
    n = F.col(f"{a}_n") + F.col(f"{b}_n")
    most = F.floor(n * (100 - PERCENT) / (100 + PERCENT))
    usual = SET_BITS / 2 * (1 - F.exp(most * (-2 / SET_BITS))) + SIGMAS * F.sqrt(SET_BITS / 4 * (1 - F.exp(most * (-4 / SET_BITS)))) + 1
    cut = BITS // 64
    return _differ(f"{a}_sketch", f"{b}_sketch", 0, cut), _differ(f"{a}_sketch", f"{b}_sketch", cut, cut + SET_BITS // 64), F.least(most, usual)


def _alike(a: str, b: str) -> F.Column:
    """What a pair that may be linked must meet: sizes that allow the similarity, and close sketches."""
    samples, own, most = _bits(a, b)
    sizes = 100 * F.least(f"{a}_n", f"{b}_n") >= PERCENT * F.greatest(f"{a}_n", f"{b}_n")
    return sizes & (samples <= MOST) & (own <= most)


def _apart(a: str, b: str) -> F.Column:
    """How far apart a pair is by its sketches, each as a share of what a link allows: that of the sets is the sharper one until it is full."""
    samples, own, most = _bits(a, b)
    return samples / MOST + own / F.greatest(most, F.lit(1))


def _untried(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) that no table of tried has, either way round: a pair that failed fails again."""
    for tries in tried[:1]:
        for more in tried[1:]:
            tries = tries.unionByName(more)
        pairs = pairs.join(tries.unionByName(tries.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    return pairs


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """node and s (the bytes of its sorted hashes), made again from the whole texts of the documents in ids (staged; node)."""

    def sets(batches):
        shingler = Shingler(width)
        for pdf in _parts(batches):
            yield pd.DataFrame({"node": pdf["node"], "s": [shingler(t if isinstance(t, str) else "").tobytes() for t in pdf["text"]]})

    plain = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return plain.join(sized(ids, 40), "node", "left_semi").mapInPandas(sets, "node long, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (staged; a, b: nodes, each pair once) whose full sets meet the threshold. A centre a may have any number of pairs; b has few."""

    def links(batches):
        for pdf in _parts(batches):
            keep = []
            for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(100 * common >= PERCENT * (len(p) + len(q) - common) > 0)
            yield pdf.loc[keep, ["a", "b"]]

    # A centre's set goes to as many parts as its pairs need: each part has 200 pairs or so.
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 200).cast("int").alias("parts"))
    left = sets.withColumnRenamed("node", "a").join(parts, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("s").alias("sa"))
    # The parts of a hot centre are found by broadcast: those with over one part, which are one for 200 pairs at most.
    many = parts.filter("parts > 1")
    spread = pairs.join(F.broadcast(many) if pairs.rows // 200 <= BROADCAST_BYTES // 60 else many, "a", "left")
    spread = spread.withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    both = spread.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(left, ["a", "part"])
    return both.select("a", "b", "sa", "sb").mapInPandas(links, "a long, b long")


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        before = least.copy()
        low = np.minimum(before[x], before[y])
        for ends in (x, y, before[x], before[y]):
            np.minimum.at(least, ends, low)
        least = least[least]
        if (least == before).all():
            return nodes, nodes[least]


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) of every node with an edge (staged; a, b).

    Up to HERE edges come to the driver. More go through alternating large-star and small-star steps until nothing changes; each is a shuffle of the edges, and each step's
    result is written to the shared folder.
    """
    if edges.rows <= HERE:
        got = edges.select("a", "b").toArrow()
        node, component = _least(*(got[x].to_numpy() for x in ("a", "b")))
        return edges.sparkSession.createDataFrame(pa.table({"node": node, "component": component}))
    marks = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = marks(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = staged(small, "edges")
        before, mark = mark, marks(after)
        dropped(now)
        now = after
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs. Documents of similarity 0.8 or more are linked.

    Null or empty texts have no shingles and no links. Rows that share a doc_id count as one document: they are in one
    component. A null doc_id can't name a component: such a row is kept and has a null component_id. Equal texts are
    linked. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    signed = staged(signatures(docs, width), "signatures")
    total = signed.rows
    # Nodes: distinct sets, named by their smallest doc_id. All rows of a set have the same bands and sketch.
    firsts = [F.first(c).alias(c) for c in ("n", "bands", "sketch")]
    nodes = staged(signed.filter("n > 0").groupBy("own").agg(F.min("doc_id").alias("node"), F.count("*").alias("times"), *firsts), "nodes")
    slim = nodes.filter(F.col("node").isNotNull()).select("node", F.explode("bands").alias("band"))
    crowded = staged(slim.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "crowded", "members")
    members = staged(staged_skew_join(slim, crowded, "band", "members", total * BANDS, "inner").select("node", "band"), "members")
    ids = staged(members.select("node").distinct(), "ids")
    facts = staged(nodes.select("node", "n", "sketch", "bands").join(sized(ids, 40), "node", "left_semi"), "facts")
    sets = staged(full_sets(docs, ids, width), "sets")
    joined = staged(ids.select("node", F.col("node").alias("component")), "components")

    def linked(pairs: DataFrame) -> DataFrame:
        """The components (a, b) of the ends of the pairs that are links."""
        of = sized(joined, 60)
        ends = confirmed(pairs, sets).join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        return staged(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")

    def merged(links: DataFrame) -> DataFrame:
        """The components after these links between components."""
        now = components(links).select(F.col("node").alias("was"), F.col("component").alias("now"))
        now = F.broadcast(now) if links.rows <= HERE else now
        return staged(joined.join(now, joined["component"] == now["was"], "left").select(joined["node"], F.coalesce("now", "component").alias("component")), "components")

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and sketches allow, and z, how far apart the sketches are. a may be in any number of pairs, b too."""
        small = facts.rows <= BROADCAST_BYTES // 400
        pairs = pairs if small else staged(pairs, "pairs")
        for x in ("a", "b"):
            some = facts.select("node", "n", "sketch")
            if small:  # named after the join, so that one broadcast serves both
                pairs = pairs.join(F.broadcast(some), F.col(x) == F.col("node")).drop("node")
            else:
                some = pairs.groupBy(x).agg(F.count("*").alias("k")).join(some.withColumnRenamed("node", x), x)
                pairs = skew_join(pairs, some, x, "k", total, "inner").drop("k")
            pairs = pairs.withColumnsRenamed({"n": f"{x}_n", "sketch": f"{x}_sketch"})
        return pairs.filter(_alike("a", "b")).select("a", "b", _apart("a", "b").alias("z"))

    tried = []
    for turn in range(ROUNDS):
        docs.sparkSession._jvm.System.gc()  # the driver gives back what the plans before have left
        named = members.join(sized(joined, 60), "node").select("band", "node", "component")
        draw = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), F.col("node").alias("a"), F.col("component").alias("centre"))).alias("c")
        centres = named.groupBy("band").agg(F.count("*").alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi"), draw).filter("lo < hi").select("band", "k", "c.a", "c.centre")
        centres = staged(centres, "centres", "k")
        if not centres.rows:
            break
        pairs = staged_skew_join(named, centres, "band", "k", total * BANDS, "inner").filter("component <> centre").select("a", F.col("node").alias("b")).distinct()
        closest = alike(_untried(pairs, tried)).groupBy("b").agg(F.min(F.struct("z", "a")).alias("x"))
        tries = staged(closest.select(F.col("x.a").alias("a"), "b"), "tries")
        if not tries.rows:
            break
        tried.append(tries)
        links = linked(tries)
        if links.rows:
            joined = merged(links)
        if links.rows * PAYS < tries.rows or links.rows * GAIN < ids.rows:
            break
    # Then all that is left of buckets with several components.
    named = members.join(sized(joined, 60), "node").select("band", "node", "component")
    kinds = named.groupBy("band", "component").agg(F.count("*").alias("k")).groupBy("band").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("kinds"), F.sum("k").alias("k")).filter("kinds > 1")
    kinds = staged(kinds.select("band", "main", "k"), "kinds", "k")
    if kinds.rows:
        docs.sparkSession._jvm.System.gc()
        # Sizes and sketches go along, so that the join itself leaves out what they rule out.
        mixed = staged_skew_join(named, kinds, "band", "k", total * BANDS, "inner").select("band", "node", "component", "main")
        mixed = staged(mixed, "mixed").join(sized(facts, 700), "node")
        side = lambda df, x, *more: df.select("band", *[F.col(c).alias(f"{x}_{c}") for c in ("n", "sketch", "component", "bands")], F.col("node").alias(x), *more)
        outside, others = side(mixed.filter("component <> main"), "a"), side(mixed, "b", (F.col("component") == F.col("main")).alias("b_main"))
        allowed = (F.col("a_component") != F.col("b_component")) & (F.col("b_main") | (F.col("a") < F.col("b"))) & _alike("a", "b")
        once = F.col("band") == F.array_min(F.array_intersect("a_bands", "b_bands"))
        rest = outside.withColumnRenamed("band", "a_band").join(others, (F.col("a_band") == F.col("band")) & allowed & once).select("a", "b")
        rest = staged(_untried(rest, tried), "rest")
        links = linked(rest) if rest.rows else rest
        if links.rows:
            joined = merged(links)
    classes = nodes.join(sized(joined, 60), "node", "left").select("own", "times", F.coalesce("component", "node").alias("component"))
    out = staged_skew_join(signed.select("doc_id", "n", "own"), staged(classes, "classes", "times"), "own", "times", total)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs of which each component keeps one, with their own columns, whatever their names."""
    gone = staged(near_duplicates(docs, width).filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    rows = rowed(docs, docs["doc_id"].cast("long").alias("id"))
    return rows.join(sized(gone, 40), F.col("id") == F.col("gone"), "left_anti").select("row.*")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its component, by shingles of two words; null texts have none."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: All pairs by shared shingles, and the components by reachability; for small tables.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), k AS (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(k.y, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(k.y, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
