"""Byte-level BPE encoding and decoding.

A word (a match of the split pattern) is an array of byte tokens. A fold in
Spark's higher-order functions merges, one after the other, the adjacent pair of
lowest rank, the leftmost of equals, until no pair has a rank, as the tiktoken
library does. The rank map is a literal of the plan: a sparse matrix packed in
two arrays, so that a look-up is two array reads. It maps a pair of tokens to the
rank of their joined bytes.

Distinct words are counted over a share of the documents (SHARE), and the frequent
ones (at most WORDS of them, of at most WORD_BYTES bytes each) are folded once.
That table is broadcast; a pass over all texts looks each word up, so a text becomes
the ids of its known stretches and the words between them, and those words alone are
folded where they stand. Which words are in the table changes no result, only where
they are folded. No text is shuffled. Decoding concatenates the byte pieces of the ids, of known stretches and
of folded words alike.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import small_batches, table

#: Words that the broadcast table has at most, their length at most, and times that one occurs in the counted documents at least: a bound of about 200 MB in a Python worker.
WORDS, WORD_BYTES, WORTH = 1 << 20, 48, 2
#: The share of documents, drawn by this seed, whose words are counted for the table. Every document is encoded in full.
SHARE, SEED = 0.25, 8
#: What stands for no rank; the token that stands before and after each word; counts in one octave of the histogram of counts.
NONE, EDGE, STEPS = 1 << 17, 65_535, 32
#: Rows that Python works on at a time.
PART = 128
#: A pair is one number: rank, first byte and left token, so that the least one is the leftmost of the lowest rank.
RANK_AT, FIRST_AT = 44, 16
# What \s stands for in the pattern (Unicode's White_Space); Java's \s is ASCII only.
SPACE = r"\t\n\x0B\f\r\x20\x85\xA0  -     　"


def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


@functools.cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """What finds all matches of the pattern in a text, made once in a worker.

    Python's own engine takes less than half the time of regex, but lacks the classes of Unicode. They are written out as regex
    defines them, up to U+FFFF; texts with characters beyond, and patterns with anything else that differs, are left to regex.
    """
    import regex

    whole = regex.compile(pattern).findall
    if "{" in pattern.replace(r"\p{", "") or "[:" in pattern:
        return whole
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    ranges = lambda kind: "".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in regex.findall(f"{kind}+", plane))
    parts, inside = [], False
    for x in re.findall(r"\\p\{\w+\}|\\.|\(\?.|.", pattern, re.DOTALL):
        if x in (r"\p{L}", r"\p{N}", r"\s"):
            parts.append(ranges(x) if inside else f"[{ranges(x)}]")
        elif x == r"\S" and not inside:
            parts.append(f"[^{ranges(chr(92) + 's')}]")
        elif x[0] == "\\" or x[:2] == "(?" and x not in ("(?!", "(?=", "(?:"):
            return whole
        else:
            inside = x == "[" or inside and x != "]"
            parts.append(x)
    plain = re.compile("".join(parts)).findall
    return lambda text: plain(text) if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else whole(text)


def pair_table(vocab: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """The map from pairs of tokens to the rank of their joined bytes, as a sparse matrix whose rows lie over each other.

    Token `left` has its row at offset[left]; entries[offset[left] + right] is (left + 1) << 17 | rank if the pair has one, and 0
    where there is no entry, which keeps the literal short. Rows are placed, the fullest first, where their entries hit free places.
    """
    made = [(vocab[token[:i]], vocab[token[i:]], rank) for token, rank in vocab.items() for i in range(1, len(token)) if token[:i] in vocab and token[i:] in vocab]
    pairs = np.array(made, np.int64).reshape(-1, 3)
    del made
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    lefts, begin, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    width = EDGE + 1
    offset, entries = np.zeros(width, np.int64), np.zeros(8 * width, np.int64)
    free, draw, at, top, size = np.ones(8 * width, bool), np.random.default_rng(8), 0, 5 * width // 2, 1 << 17

    def fit(tries: np.ndarray, cols: np.ndarray) -> int | None:
        good = np.flatnonzero(free[tries[:, None] + cols[:8]].all(1))
        return next((int(tries[g]) for g in good if free[tries[g] + cols].all()), None)

    for k in np.lexsort((lefts, -count)):
        cols, place = pairs[begin[k] : begin[k] + count[k], 1], None
        if len(cols) == 1:  # any free place is one
            place = int(np.argmax(free[cols[0] :]))
        for _ in range(20 if place is None and len(cols) <= 16 else 0):  # short rows fall into gaps
            if (place := fit(draw.integers(0, top - width, 256), cols)) is not None:
                break
        if len(cols) <= size // 2:  # shorter rows may fit where longer ones did not
            at, size = 0, len(cols)
        while place is None:  # long ones, and what found no gap, go on where the last was placed
            place = fit(np.arange(at, at + 256), cols)
            at = at + 256 if place is None else place
        offset[lefts[k]] = place
        free[place + cols] = False
        entries[place + cols] = (lefts[k] + 1) << 17 | pairs[begin[k] : begin[k] + count[k], 2]
    return offset.tolist(), entries[: int(offset.max()) + width].tolist()


def _array(kind: str, values: list) -> Column:
    """An array as a literal: the optimizer folds the parsing of its JSON once, before the plan runs."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"), ensure_ascii=False)), f"array<{kind}>")


def _strings(values: Iterable[bytes]) -> Column:
    """An array of bytes as a literal, each as a string that holds them as they are, UTF-8 or not: Spark joins such without a look at them."""
    return _array("binary", [base64.b64encode(v).decode() for v in values]).cast("array<string>")


def _let(value: Column, body) -> Column:
    """body of value, which is made once: the end of an aggregate over nothing. Its type is that of value, so no type is worked out anew for each word."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


class Codec:
    """Expressions that encode and decode by one vocabulary (under 65,535 tokens, every single byte among them)."""

    def __init__(self, vocab: dict[bytes, int], pattern: str) -> None:
        if max(vocab.values()) >= EDGE or any(bytes([b]) not in vocab for b in range(256)):
            raise ValueError("ranks must be under 65,535 and hold all single bytes")
        self.pattern, self.java = pattern, java_pattern(pattern)
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, rank in vocab.items():
            self.pieces[rank] = token
        offset, entries = pair_table(vocab)
        self._offset, self._entries = _array("int", offset), _array("bigint", entries)
        self._pieces, self._packed = _strings(self.pieces), _strings(i.to_bytes(4, "little") for i in range(len(self.pieces)))
        first = [vocab[bytes([b])] for b in range(256)]
        # By two bytes, and after those by the last byte of a word: the pair of both, at byte 0.
        self._begin = _array("bigint", [vocab.get(bytes([a, b]), NONE) << RANK_AT | first[a] for a in range(256) for b in range(256)] + [NONE << RANK_AT | x for x in first])

    def fold(self, word: Column) -> Column:
        """The token ids of one non-empty word."""
        byte = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c))
        paired = lambda b: F.transform(b, lambda x, i: F.coalesce(F.shiftleft(x, 8).bitwiseOR(F.get(b, i + 1)), x + (1 << 16)))
        return self.fold_paired(_let(byte, paired))

    def fold_paired(self, code: Column) -> Column:
        """The token ids of one non-empty word, of which code has each byte with the next one: 256 * byte + next; for the last, 65,536 + byte."""
        high = lambda rank: F.shiftleft(rank, RANK_AT)
        token = lambda x: x.bitwiseAND(F.lit(EDGE))
        wall = F.array(F.lit(NONE << RANK_AT | EDGE))

        def begin(b: Column) -> Column:
            return F.concat(wall, F.transform(b, lambda x, i: F.get(self._begin, x).bitwiseOR(F.shiftleft(i.cast("bigint"), FIRST_AT))), wall)

        def ranked(x: Column, right: Column) -> Column:
            """x, a pair without its rank, with it. An entry of another row keeps higher bits: it counts as no rank."""
            left = token(x)
            rank = F.get(self._entries, F.get(self._offset, left.cast("int")) + right.cast("int")).bitwiseXOR(F.shiftleft(left + 1, 17))
            return high(F.least(rank, F.lit(NONE).cast("bigint"))).bitwiseOR(x)

        def merge(v: Column, low: Column, at: Column, left: Column) -> Column:
            """v after the merge of its least pair, low, at this place (from 1), after left. All pairs differ, as they hold their first byte."""
            joined = F.shiftright(low, RANK_AT)
            bare = F.array(left.bitwiseAND(F.lit((1 << RANK_AT) - 1)), low.bitwiseAND(F.lit((1 << RANK_AT) - (1 << FIRST_AT))).bitwiseOR(joined))
            both = F.zip_with(bare, F.array(joined, token(F.get(v, at + 1))), ranked)
            # Two passes by element cost less than slices that are concatenated.
            put = lambda new: F.transform(v, lambda x: F.when(x == low, F.get(new, F.lit(1))).when(x == left, F.get(new, F.lit(0))).otherwise(x))
            return F.array_remove(_let(both, put), F.get(v, at))

        def turn(v: Column, _: Column) -> Column:
            place = lambda low: F.when(low < NONE << RANK_AT, _let(F.array_position(v, low).cast("int"), lambda at: _let(F.get(v, at - 2), lambda left: merge(v, low, at, left)))).otherwise(v)
            return _let(F.array_min(v), place)

        def whole(b: Column) -> Column:
            return F.aggregate(F.slice(b, F.lit(2), F.size(b)), begin(b), turn, lambda v: F.transform(F.slice(v, F.lit(2), F.size(v) - 2), lambda x: token(x).cast("int")))

        return _let(code, whole)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.java), F.lit(0))

    def encode(self, text: Column) -> Column:
        """array<int> of a text's ids, each of its words folded where it stands."""
        return F.flatten(F.transform(self.words(text), self.fold))

    def decode(self, ids: Column) -> Column:
        """binary: the bytes of the ids' pieces, one after the other."""
        return F.array_join(F.transform(ids, lambda i: F.get(self._pieces, i)), "").cast("binary")

    def pack(self, ids: Column) -> Column:
        """binary: the ids as little-endian unsigned 32-bit integers; their upper half is 0."""
        return F.array_join(F.transform(ids, lambda i: F.get(self._packed, i)), "").cast("binary")


def frequent(docs: DataFrame, codec: Codec) -> pa.Table:
    """w and ids of the frequent words of a share of docs (a column text), at most WORDS of them."""
    counts = docs.sample(SHARE, SEED).select(F.explode(codec.words(F.col("text"))).alias("w")).groupBy("w").count().filter((F.col("count") >= WORTH) & (F.octet_length("w") <= WORD_BYTES))
    # Read twice; a lost part is counted again.
    counts = counts.select("w", F.floor(F.log2("count") * STEPS).cast("int").alias("step")).persist(StorageLevel.DISK_ONLY)
    # The step from which the words number at most WORDS: as many rows as the histogram has steps.
    left, least = WORDS, 1 << 30
    for step, n in sorted(map(tuple, counts.groupBy("step").count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = step
    out = counts.filter(F.col("step") >= least).select("w", codec.fold(F.col("w")).alias("ids")).toArrow()
    counts.unpersist()
    return out


#: What this Python worker has made of the last broadcast table.
_known: dict[str, dict[str, bytes]] = {}


def _table_of(sent) -> dict[str, bytes]:
    tag, stream = sent.value
    if tag not in _known:
        _known.clear()
        own = _known[tag] = {}
        for batch in pa.ipc.open_stream(stream):
            ids = batch.column(1)
            packed, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() - ids.offsets[0].as_py()) * 4
            own.update((w, packed[a:b]) for w, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    return _known[tag]


def _paired(words: list[list[str]]) -> pa.Array:
    """Each of the non-empty words as fold_paired reads it."""
    made = [w.encode() for ws in words for w in ws]
    ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
    byte = np.frombuffer(b"".join(made), np.uint8).astype(np.int32)
    code = byte << 8
    code[:-1] |= byte[1:]
    code[ends[1:] - 1] = byte[ends[1:] - 1] + (1 << 16)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(code)))


def encoded(docs: DataFrame, codec: Codec, *keep: str, ids: bool = True, order: tuple[str, ...] = ()) -> DataFrame:
    """The columns keep of every row of docs, then ids (array<int>; or packed, the ids as little-endian unsigned 32-bit integers) and decoded (binary).

    order: columns among keep that the result is ordered by; the texts are sorted before they are encoded, not after.
    Null text counts as empty: no ids, no bytes. Rows that repeat are rows of the result; an empty table gives an empty
    result. Other columns than keep and text play no part. A text's length has no bound; a word is folded in time that grows
    with the square of its length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if spark.conf.get("spark.sql.maxPlanStringLength").startswith("2147483632"):  # unset: plans hold the tables; their descriptions needn't
        spark.conf.set("spark.sql.maxPlanStringLength", "8192")
    if spark.conf.get("spark.sql.debug.maxToStringFields") == "25":  # unset: each description of a plan would write the tables out, and its parts anew at every level
        spark.conf.set("spark.sql.debug.maxToStringFields", "1")
    text = F.coalesce("text", F.lit("")).alias("text")
    spark._jvm.System.gc()  # the driver gives back what earlier work has left, before the tables are made, and again after their first use
    known, stream = frequent(docs.select(text), codec), pa.BufferOutputStream()
    spark._jvm.System.gc()
    with pa.ipc.new_stream(stream, known.schema) as out:
        out.write_table(known, 50_000)
    del known
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, stream.getvalue().to_pybytes()))
    del stream
    pattern, pieces = codec.pattern, codec.pieces

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text as its known stretches, with their ids and what these decode to, and the words between them."""
        table_, split, own = _table_of(sent), splitter(pattern), pa.array(pieces, pa.binary())
        for batch in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):
            parts, rare = [], []
            ends = [0]
            for t in batch.column(1).to_pylist():
                words = split(t)
                found = list(map(table_.get, words))
                gaps = [i for i, x in enumerate(found) if x is None]
                parts += [b"".join(found[a + 1 : b]) for a, b in zip([-1, *gaps], [*gaps, len(found)], strict=True)]
                rare.append([words[i] for i in gaps])
                ends.append(len(parts))
            every = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
            at = np.cumsum([0, *map(len, parts)]).astype(np.int32) // 4
            taken = own.take(pa.array(every))
            starts = np.frombuffer(taken.buffers()[1], np.int32)[: len(every) + 1]
            decoded = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(starts[at].tobytes()), taken.buffers()[2] or pa.py_buffer(b"")])
            listed = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            told = pa.ListArray.from_arrays(pa.array(at), pa.array(every)) if ids else pa.array(parts, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(told), listed(decoded), _paired(rare)], ["row", "told", "decoded", "rare"])

    plain = (docs.orderBy(*order) if order else docs).select(F.struct(*[F.col(c) for c in keep]).alias("row"), text)
    kind = plain.schema["row"].dataType.simpleString()
    out = plain.mapInArrow(stretches, f"row {kind}, told {'array<array<int>>' if ids else 'array<binary>'}, decoded array<binary>, rare array<array<int>>")
    out = out.select("row", "told", "decoded", F.transform("rare", codec.fold_paired).alias("folded"))
    between = lambda a, made, empty: F.zip_with(a, made, lambda x, y: F.concat(x, F.coalesce(y, empty)))
    told = F.flatten(between("told", "folded", F.array().cast("array<int>"))) if ids else _joined(between("told", F.transform("folded", codec.pack), F.lit(b"")))
    return out.select("row.*", told.alias("ids" if ids else "packed"), _joined(between("decoded", F.transform("folded", codec.decode), F.lit(b""))).alias("decoded"))


def _joined(parts: Column) -> Column:
    """The binaries, one after the other. A cast to string and back leaves bytes as they are."""
    return F.array_join(parts.cast("array<string>"), "").cast("binary")


def public_codec(name: str = "byte_bpe_multi_50k.tiktoken") -> Codec:
    import public_tokenizers

    return Codec(ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs."""
    out = encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), codec, "doc_id", ids=False)
    return out.select("doc_id", F.floor(F.octet_length("packed") / 4).cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded. Null text: no ids, digests of no bytes."""
    return digests(table(spark, sf_dir, "documents"), public_codec())
