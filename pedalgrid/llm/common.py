"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[\x20\x09-\x0D]`, the white space of every contract here.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_rows(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text) with null texts as empty ones.

    The key is a 128-bit hash of id and text: rows that agree in both share it, so it can be
    computed again at any time and does not depend on where a row lies. Other columns of
    ``docs`` are left out and cannot clash.
    """
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")]
    return docs.select(
        F.xxhash64(*parts).alias("k1"),
        F.xxhash64(F.lit(1), *parts).alias("k2"),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
    )


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(k1, k2, row): whole rows packed in a struct, so that none of their columns can clash."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")]
    return docs.select(
        F.xxhash64(*parts).alias("k1"),
        F.xxhash64(F.lit(1), *parts).alias("k2"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )


# numpy side: strings as arrays of 64-bit hashes

_POWER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n. One array per base is kept, as long as the longest asked for."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(1 << max(16, (n - 1).bit_length()), np.uint64(base), np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:n]


BASE = int(_POWER)
INVERSE = _inverse(BASE)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: two of them and a power give the hash of any piece."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def piece_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the pieces [start, end) of what ``sums`` was made from."""
    raw = (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]
    return mix64(raw + (end - start).astype(np.uint64) * _MIX[1])


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all pieces of one width of what ``sums`` was made from, as :func:`piece_hash` gives them."""
    raw = sums[width:] - sums[:-width]
    raw *= powers(INVERSE, len(raw))
    raw += np.uint64(width * int(_MIX[1]) % (1 << 64))
    return mix64(raw)


_SPACE = np.zeros(256, bool)
_SPACE[list(BLANKS.encode())] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def shingle_hashes(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word shingles of some texts: (hashes, offsets, words).

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. Text i owns
    ``hashes[offsets[i]:offsets[i + 1]]`` in word order, repeats included. A text with fewer
    words than ``width`` is one shingle, a text without words has none.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _FOLD[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    ends = np.cumsum([len(p) + 1 for p in parts])
    blank = _SPACE[data]
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = piece_hash(prefix_hash(data), first, last)
    owner = np.searchsorted(ends, first, side="right")
    words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(words)))
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begin[:-1], count)
    if len(word) >= width:
        full = np.zeros(len(word), np.uint64)
        for i in range(width):
            full[: len(word) - width + 1] += word[i : len(word) - width + 1 + i] * powers(BASE, width + 1)[i + 1]
        hashes = mix64(full[at])
    else:
        hashes = np.zeros(len(at), np.uint64)
    for i in np.flatnonzero((words > 0) & (words < width)):
        own = word[begin[i] : begin[i + 1]]
        whole = (own * powers(BASE, width + 1)[1 : len(own) + 1]).sum(dtype=np.uint64)
        hashes[offsets[i]] = mix64(np.array([whole ^ np.uint64(len(own))]))[0]
    return hashes, offsets, words


def text_groups(texts: list[str], size: int = 1 << 18):
    """Ranges (from, to) of a batch with about ``size`` characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


#: Rows of text that a Python worker is given at once, where a step asks for small batches.
BATCH, BATCH_SIZE = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand ``BATCH`` rows at most to Python at once, which bounds a worker's memory."""
    before = spark.conf.get(BATCH_SIZE)
    spark.conf.set(BATCH_SIZE, min(int(before), BATCH) if int(before) > 0 else BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SIZE, before)


def sorted_unique(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


#: Bits of the filter that keeps texts nobody asks for out of a shuffle: at most 2 MB.
FILTER_BITS = 1 << 23


def asked_for(rows: DataFrame, wanted: DataFrame) -> tuple[Column, DataFrame]:
    """A test that every row whose (k1, k2) is in ``wanted`` passes, and few others do.

    Returns the test and ``rows`` with what it needs. The keys set bits of a table of fixed size, which is
    broadcast; with very many keys the test passes all rows, and the join behind it decides.
    """
    place = F.col("k1").bitwiseAND(F.lit(FILTER_BITS - 1))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast((k1 & {FILTER_BITS - 1}) & 63 as int))")
    words = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    tested = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left").drop("_word")
    return F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)), tested


def join_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Inner join on (k1, k2) that shuffles few rows besides those in ``wanted``."""
    test, tested = asked_for(rows, wanted)
    return tested.filter(test).drop("_bits").join(wanted, ["k1", "k2"])
