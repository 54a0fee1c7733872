"""Substring dedup: windows of words that an earlier document holds, behind a count-min prefilter.

1. *Sketch.* Every window of ``width`` words is known by the least hash of its word n-grams of half that length: equal
   windows have equal ones, and neighbouring windows mostly share theirs, so a text of many windows counts few
   things. Each task counts them, once per document, in a count-min sketch whose cells stop at two; the sketches are
   merged by adding. A window of two documents or more never counts less than two.
2. *Groups.* Windows estimated to be in two documents or more are grouped exactly, by 96 bits of hash. All others
   are in one document only and are never shuffled. A window group's first document is found by partial
   aggregates; the windows of later documents meet it in a join that adaptive execution can split.

The width of the sketch follows the size of the texts up to ``MOST_CELLS``. Beyond that more windows pass it, and the
groups still decide exactly. Documents whose whole text an earlier one has need neither step.

Defined results: a null or empty text has no words. Documents are ordered by id, a null id last; rows that repeat an id
are one document, so they do not remove each other's windows. A text with fewer words than a window
stays whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalgrid.llm.common import BLANKS, asked_for, mix64, powers, small_batches, text_groups, text_rows
from pedalgrid.session import cut_lineage

WIDTH = 50
#: Rows of the sketch, its most cells in a row, and the cells that are merged as one piece.
ROWS, MOST_CELLS, PIECE = 4, 1 << 25, 1 << 17
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[list(BLANKS.encode())] = True


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def _pieces(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), len(sums))[start])


class Words:
    """The words of some texts: hashes, and for each text how many and from where."""

    def __init__(self, texts: list[str], bases: tuple[int, ...] = BASES):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        edge = np.diff(np.concatenate(([True], _SPACE[data])).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        raw = data.astype(np.uint64) + np.uint64(1)
        self.sums = [_sums(_pieces(_sums(raw, b), first, last, b), b) for b in bases]
        self.bases = bases
        owner = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), first, side="right")
        self.count = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        self.begin = np.cumsum(self.count) - self.count

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, first word counted over all texts) of all windows of ``width`` words."""
        n = np.maximum(self.count - width + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        return text, np.arange(len(text)) + np.repeat(self.begin - (np.cumsum(n) - n), n)

    def hashes(self, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
        return _pieces(self.sums[which], at, at + width, self.bases[which])

    def least(self, width: int) -> np.ndarray:
        """By first word: the least hash of the n-grams of half the length in a window."""
        gram = (width + 1) // 2
        found = self.hashes(np.arange(max(len(self.sums[0]) - gram, 0)), gram)
        left, reach = width - gram + 1, 1
        while reach < left:  # windows of n-grams twice as long, up to the length asked for
            step = min(reach, left - reach)
            found = np.minimum(found[:-step], found[step:])
            reach += step
        return found


def _cells(names: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each name, one per row of the sketch, counted over all rows."""
    rows = np.arange(ROWS, dtype=np.uint64)[:, None]
    spread = mix64(names[None, :] + rows * np.uint64(BASES[1]))
    return (spread % np.uint64(cells) + rows * np.uint64(cells)).astype(np.int64)


def sketch_width(n_bytes: int, width: int = WIDTH) -> int:
    """Twice the names to expect in so many bytes of text, as a power of two."""
    names = n_bytes / 6 / max(width / 4, 1)
    return int(min(MOST_CELLS, max(PIECE, 1 << int(2 * names).bit_length())))


def merged_sketch(rows: DataFrame, cells: int, width: int = WIDTH) -> np.ndarray:
    """Bits of all cells that count two documents or more. A cell counts to two, in two bits."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(ROWS * cells // 8, np.uint8), np.zeros(ROWS * cells // 8, np.uint8)
        for b in batches:
            texts = b["text"].tolist()
            for a, z in text_groups(texts):
                words = Words(texts[a:z], BASES[:1])
                text, at = words.windows(width)
                if not len(at):
                    continue
                name = words.least(width)[at]
                new = np.concatenate(([True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])))
                name, text = name[new], text[new]
                order = np.lexsort((name, text))
                name, text = name[order], text[order]
                first = np.concatenate(([True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])))
                hit, times = np.unique(_cells(name[first], cells), return_counts=True)
                byte, bit = hit >> 3, np.uint8(128) >> (hit & 7).astype(np.uint8)
                more = ((once[byte] & bit) != 0) | (times > 1)
                np.bitwise_or.at(twice, byte[more], bit[more])
                np.bitwise_or.at(once, byte, bit)
        once, twice = once.reshape(-1, PIECE // 8), twice.reshape(-1, PIECE // 8)
        used = np.flatnonzero(once.any(axis=1))
        for i in range(0, len(used), 64):
            some = used[i : i + 64]
            packed = [zlib.compress(once[p].tobytes() + twice[p].tobytes(), 1) for p in some]
            yield pd.DataFrame({"piece": some, "counts": packed})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, tuple] = {}
        for b in batches:
            for p, c in zip(b["piece"], b["counts"], strict=True):
                once, twice = np.frombuffer(zlib.decompress(c), np.uint8).reshape(2, -1)
                if p in total:
                    known = total[p]
                    once, twice = known[0] | once, known[1] | twice | (known[0] & once)
                total[p] = once, twice
        yield pd.DataFrame({"piece": list(total), "counts": [twice.tobytes() for _, twice in total.values()]})

    schema = "piece int, counts binary"
    merged = rows.select("text").mapInPandas(count, schema).repartition("piece").mapInPandas(add, schema)
    bits = np.zeros((ROWS * cells // PIECE, PIECE // 8), np.uint8)
    for p, c in merged.collect():  # as many bits as the sketch has cells
        bits[p] = np.frombuffer(c, np.uint8)
    return bits.reshape(-1)


def repeated_windows(rows: DataFrame, bits: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(h1, h2, no_id, doc_id, k1, k2, pos) of the windows estimated to be in several documents."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    cells = len(bits) * 8 // ROWS
    kept = ["no_id", "doc_id", "k1", "k2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            texts = b["text"].tolist()
            for a, z in text_groups(texts):
                words = Words(texts[a:z])
                text, at = words.windows(width)
                if not len(at):
                    continue
                name = words.least(width)[at]
                new = np.concatenate(([True], name[1:] != name[:-1]))  # neighbours share a name
                cell = _cells(name[new], cells)
                several = ((known[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).all(axis=0)
                keep = several[np.cumsum(new) - 1]
                text, at = text[keep], at[keep]
                out = pd.DataFrame({"h1": words.hashes(at, width).view(np.int64), "h2": words.hashes(at, width, 1).astype(np.uint32).view(np.int32)})
                for c in kept:
                    out[c] = b[c].to_numpy()[a:z][text]
                out["pos"] = (at - words.begin[text]).astype(np.int32)
                yield out

    schema = f"h1 long, h2 int, no_id boolean, doc_id {dict(rows.dtypes)['doc_id']}, k1 long, k2 long, pos int"
    return rows.select(*kept, "text").mapInPandas(run, schema)


def earlier_copies(rows: DataFrame) -> DataFrame:
    """(k1, k2, copied) of all rows: whether an earlier document has the same text."""
    named = rows.select(
        "k1", "k2", "no_id", "doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")
    )
    first = named.groupBy("t1", "t2").agg(F.min(F.when(~F.col("no_id"), F.col("doc_id"))).alias("first"))
    late = F.col("first").isNotNull() & (F.col("no_id") | (F.col("doc_id") > F.col("first")))
    return named.join(first, ["t1", "t2"]).select("k1", "k2", late.alias("copied")).distinct()


def late_windows(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(k1, k2, copied, starts): the windows that an earlier document holds; all of them where ``copied``."""
    copies = cut_lineage(earlier_copies(rows), "copies")
    test, tested = asked_for(rows, copies.filter("NOT copied").select("k1", "k2"))
    own = tested.filter(test).drop("_bits")  # few copies are left, and those do no harm
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = merged_sketch(own, sketch_width(n_bytes, width), width)
    windows = cut_lineage(repeated_windows(own, bits, width), "windows")
    with_id = F.when(~F.col("no_id"), F.col("doc_id"))
    several = (
        windows.groupBy("h1", "h2")
        .agg(F.min(with_id).alias("first"), F.max(with_id).alias("last"), F.max("no_id").alias("none"))
        .filter("first < last OR (none AND first IS NOT NULL)")
    )
    # stored, so that the join has a plain shuffle on both sides and a hot window can be split
    several = cut_lineage(several.select("h1", "h2", "first"), "repeated")
    late = windows.join(several, ["h1", "h2"]).filter("no_id OR doc_id > first")
    starts = late.groupBy("k1", "k2").agg(F.collect_set("pos").alias("starts"))
    return (
        copies.filter("copied")
        .join(starts, ["k1", "k2"], "full_outer")
        .select("k1", "k2", F.coalesce("copied", F.lit(False)).alias("copied"), "starts")
    )


def kept_words(docs: DataFrame, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of ``docs``: the words that stay, joined by one space, or their
    SHA-256 with ``digest``."""
    rows = text_rows(docs).withColumn("no_id", F.col("doc_id").isNull())
    with small_batches(docs.sparkSession):
        late = cut_lineage(late_windows(rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))), width), "late-windows")
    test, tested = asked_for(rows, late.select("k1", "k2"))
    touched = tested.filter(test).drop("_bits").join(late, ["k1", "k2"], "left")
    whole = tested.filter(~test).drop("_bits").withColumns({"copied": F.lit(None), "starts": F.lit(None)})
    word = re.compile(f"[^{re.escape(BLANKS)}]+")

    def one(text: str, copied, starts) -> tuple[int, int, str]:
        words = word.findall(text)
        n = len(words)
        gone = np.zeros(n + 1, np.int64)
        if copied is True and n >= width:
            gone[0], gone[n] = 1, -1
        elif starts is not None:
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + width, -1)
        keep = np.cumsum(gone)[:n] == 0
        kept = list(itertools.compress(words, keep.tolist()))
        whole = " ".join(kept)
        return n, n - len(kept), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest() if digest else whole

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(*x) for x in zip(b["text"], b["copied"], b["starts"], strict=True)]
            out = pd.DataFrame(made, columns=["n_words", "n_removed", "kept"])
            out.insert(0, "no_id", b["no_id"].to_numpy())
            out.insert(1, "doc_id", b["doc_id"].to_numpy())
            yield out

    named = F.coalesce("doc_id", F.lit(0)).alias("doc_id")
    asked = touched.unionByName(whole).select("no_id", named, "text", "copied", "starts")
    schema = f"no_id boolean, doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept string"
    found = asked.mapInPandas(run, schema)
    return found.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept")


def window_digests(docs: DataFrame) -> DataFrame:
    return kept_words(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


SQL = f"""
WITH words AS (
  SELECT row_number() OVER () AS id, doc_id, list_filter(string_split(regexp_replace(
    coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT id, doc_id, i, sha256(array_to_string(w[i:i + {WIDTH - 1}], ' ')) AS h
  FROM words, LATERAL unnest(range(1, len(w) - {WIDTH - 2})) AS u(i)),
firsts AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT id, i + j AS pos
  FROM windows JOIN firsts USING (h), LATERAL unnest(range({WIDTH})) AS u(j)
  WHERE first_id IS NOT NULL AND (doc_id IS NULL OR doc_id > first_id)),
parts AS (
  SELECT id, doc_id, len(w) AS n, pos, w[pos] AS word
  FROM words, LATERAL unnest(range(1, len(w) + 1)) AS u(pos)),
kept AS (
  SELECT parts.id, string_agg(word, ' ' ORDER BY parts.pos) AS kept, count(*) AS c
  FROM parts LEFT JOIN gone ON gone.id = parts.id AND gone.pos = parts.pos
  WHERE gone.pos IS NULL GROUP BY parts.id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(c, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (id)
"""
