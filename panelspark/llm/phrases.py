"""Phrase collocation mining by hierarchical pair naming.

Tasks cut the texts they read into blocks of about ``BLOCK`` words, without a shuffle of
texts: an array of word numbers and the block's own dictionary. Dictionaries meet once, by
word, where frequent words get global names; each block gets back the names of its own
words and replaces every adjacent pair of frequent words by a pair of names. These pairs
meet in turn, frequent ones get a name, and adjacent frequent pairs (a b)(b c) are the
three-word phrases: no longer phrase is frequent unless the two it is made of are. A pair's
name keeps the names of its parts, which are the parts of every cut of a longer phrase and
the phrases that a longer one subsumes, so cuts and subsumption are joins on names.

A frequent word is one row for each block in a shuffle, not one for each occurrence. Sums
over a language's phrases are taken in two steps, and so is each language's top list.

Words are what stands between spaces, tabs and the separators ``SEPARATORS``, which no phrase
crosses; only A-Z is lower-cased. Null texts have no words; a null language is ``und``.
Repeated rows count each. Phrases of equal score and frequency go by their UTF-8 bytes. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, filter_bits, may_contain, member_bits, written

LEAST = 10
#: A phrase goes if a longer one that holds it has this share of its occurrences, in percent.
SUBSUMED = 50
TOP = 2000
#: Words of a block; a text is never split, so one with more makes a block by itself.
BLOCK = 2_000_000
SALTS = 64
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Stands for a separator: no byte of UTF-8 and no white space.
_CUT = 0xFF
_BYTES = bytes(_CUT if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MARK = bytes([_CUT])


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, with a mark where a phrase can't go on."""
    data = (text or "").encode("utf-8", "replace").translate(_BYTES).replace(_MARK, b" " + _MARK + b" ")
    return [w for w in data.replace(b"\t", b" ").split(b" ") if w]


def _packed(codes: np.ndarray) -> pa.Array:
    """Codes as one compressed value, their low bytes first, then the others: numbers of frequent words are small."""
    return pa.array([zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes())], pa.binary())


def _unpacked(value: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _kept(df: DataFrame) -> DataFrame:
    """``written``, with encodings for sorted numbers."""
    return written(df, {"compression": "zstd", "parquet.writer.version": "v2"})


def _sized(first: pa.Array, n: int) -> pa.Array:
    """One value, then n nulls."""
    return pa.concat_arrays([first, pa.nulls(n, first.type)])


def _after(values: pa.Array) -> pa.Array:
    """One null, then the values."""
    return pa.concat_arrays([pa.nulls(1, values.type), values])


def _blocks(docs: DataFrame) -> DataFrame:
    """The words of blocks of texts as a table ``(block, codes, code, lang, word, times)``.

    A row with ``codes`` holds a block's texts as 32-bit numbers, -1 between pieces; the
    others tell what each number stands for and how often it occurs in the block.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId() << 32, count()
        number, by, parts, held = count(), {}, [], 0

        def block() -> pa.RecordBatch:
            codes = np.concatenate(parts)
            found = [(c, lang, w.decode()) for lang, own in by.items() for w, c in own.items() if c >= 0]
            code = np.array([c for c, _, _ in found], np.int32)
            times = np.bincount(codes[codes >= 0], minlength=len(found))[code]
            n = len(found)
            columns = {
                "block": pa.array(np.full(n + 1, task + next(nth))),
                "codes": _sized(_packed(codes), n),
                "code": _after(pa.array(code, pa.int32())),
                "lang": _after(pa.array([x for _, x, _ in found], pa.string())),
                "word": _after(pa.array([x for _, _, x in found], pa.string())),
                "times": _after(pa.array(times, pa.int64())),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                found = words(text.as_py())
                own = by.setdefault(lang, defaultdict(number.__next__, {_MARK: -1}))
                parts += [np.fromiter(map(own.__getitem__, found), np.int32, len(found)), np.array([-1], np.int32)]
                held += len(found)
                if held >= BLOCK:
                    yield block()
                    number, by, parts, held = count(), {}, [], 0
        if held:
            yield block()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return _kept(rows.mapInArrow(cut, "block long, codes binary, code int, lang string, word string, times long"))


def _pairs(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Adjacent pairs of what ``names(at, code, name)`` names in each block, numbered anew, as a table ``(block, codes, code, first, second, times)``."""

    def pair(key: tuple, block: pa.Table, own: pa.Table) -> pa.Table:
        was = _unpacked(block["codes"][0].as_py())
        codes = np.concatenate([was, np.array([-1], np.int32)])
        name = np.full(codes.max(initial=-1) + 2, -1, np.int64)
        name[own["code"].to_numpy()] = own["name"].to_numpy()
        left, right = codes[:-1], codes[1:]
        good = np.flatnonzero((name[left] >= 0) & (name[right] >= 0))  # -1 takes the last place, which has no name
        both, number, times = np.unique(left[good].astype(np.int64) * len(name) + right[good], return_inverse=True, return_counts=True)
        new = np.full(len(was), -1, np.int32)
        new[good] = number
        n = len(both)
        columns = {
            "block": pa.array(np.full(n + 1, key[0].as_py())),
            "codes": _sized(_packed(new), n),
            "code": _after(pa.array(np.arange(n), pa.int32())),
            "first": _after(pa.array(name[both // len(name)])),
            "second": _after(pa.array(name[both % len(name)])),
            "times": _after(pa.array(times, pa.int64())),
        }
        return pa.table(columns)

    whole = blocks.where("codes is not null").select("block", "codes")
    return _kept(whole.groupBy("block").cogroup(names.groupBy("at")).applyInArrow(pair, "block long, codes binary, code int, first long, second long, times long"))


def _counted(pairs: DataFrame) -> DataFrame:
    """Frequent pairs ``(first, second, f, name)``."""
    found = pairs.where("code is not null").groupBy("first", "second").agg(F.sum("times").alias("f")).where(F.col("f") >= LEAST)
    return written(found.withColumn("name", F.monotonically_increasing_id()))


def _named(blocks: DataFrame, frequent: DataFrame, by: list[str]) -> DataFrame:
    """``(at, code, name)`` of the frequent ones in each block; bits, more for more frequent ones, drop most others before the join."""
    size = filter_bits(frequent.count())
    bits = member_bits(frequent.select(F.xxhash64(*by).alias("h")), "h", size)
    rows = blocks.where("code is not null").select(F.col("block").alias("at"), "code", *by)
    return rows.where(may_contain(bits, F.xxhash64(*by), size)).join(frequent.select("name", *by), by).select("at", "code", "name")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's best phrases: ``(lang, rank, phrase, a, l, r, n, score)``."""
    blocks = _blocks(docs)
    all_words = blocks.where("code is not null").groupBy("lang", "word").agg(F.sum("times").alias("f"))
    all_words = written(all_words.withColumn("name", F.monotonically_increasing_id()))
    n = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    one = all_words.where(F.col("f") >= LEAST)
    pairs = _pairs(blocks, _named(blocks, one, ["lang", "word"]))
    discard(blocks)
    two = _counted(pairs)
    triples = _pairs(pairs, _named(pairs, two, ["first", "second"]))
    discard(pairs)
    three = _counted(triples)
    discard(triples)

    def of(names: DataFrame, prefix: str, *columns: str) -> DataFrame:
        return names.select(F.col("name").alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])

    pair = two.join(of(one, "first", "f", "word", "lang"), "first").join(of(one, "second", "f", "word"), "second")
    phrase = F.concat_ws(" ", "first_word", "second_word")
    pair = written(pair.select("name", "f", F.col("first_lang").alias("lang"), phrase.alias("phrase"), "first", "first_f", "second", "second_f", "second_word"))
    # at most 7 + 15 + 15 digits over 30: no step is rounded
    divided = F.expr("(cast(1000000 as decimal(7,0)) * cast(f as decimal(15,0)) * cast(f as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")

    # a longer phrase as large a part of a shorter one as that subsumes it
    longer = three.select(F.col("first").alias("name"), "f").unionByName(three.select(F.col("second").alias("name"), "f")).groupBy("name").agg(F.max("f").alias("longer"))
    alone = pair.join(longer, "name", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * SUBSUMED))
    short = alone.select("lang", "phrase", F.col("f"), F.col("first_f").alias("l"), F.col("second_f").alias("r")).withColumn("score", divided)
    triple = three.join(of(pair, "first", "f", "lang", "phrase", "first_f"), "first").join(of(pair, "second", "f", "second_f", "second_word"), "second")
    triple = triple.select(F.col("first_lang").alias("lang"), F.concat_ws(" ", "first_phrase", "second_second_word").alias("phrase"), "f", F.array(F.struct(F.col("first_first_f").alias("l"), F.col("second_f").alias("r")), F.struct(F.col("first_f").alias("l"), F.col("second_second_f").alias("r"))).alias("cuts"))
    triple = triple.select("lang", "phrase", "f", F.posexplode("cuts").alias("k", "c")).select("lang", "phrase", "f", "k", "c.l", "c.r").withColumn("score", divided)
    long = triple.groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "f", "x.l", "x.r", "x.score")
    best = short.unionByName(long.select(short.columns))
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    out = some.withColumn("rank", rank).where(F.col("rank") <= top).join(n, "lang")
    return out.select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
