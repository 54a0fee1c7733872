"""Line dedup: first occurrences are streamed from hashes in range order, as keep bitmaps.

Every line long enough becomes (hash, document, position). The rows are range-partitioned and
sorted by all three, so a line that every document holds is spread over many partitions; each
partition streams once through its rows in constant memory. A run of equal hashes that goes
over a border is settled from two rows per partition. What comes back is one compressed bitmap
per document; texts are not shuffled for the search.

Defined results: a null or empty text is one empty line, which is kept. Documents are ordered by
id, a null id last. Rows that repeat an id count as one document. Rows that repeat
id and text get the same bitmap. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from pedalgrid.llm.common import BLANKS, ascii_lower, keyed_rows, text_rows
from pedalgrid.session import cut_lineage, shuffle_width

MIN_CHARS = 10

FOUND = "kind int, k1 long, k2 long, pos int, h1 long, h2 long, no_id boolean, doc_id {id}"
DROP, OPEN, LAST = 0, 1, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    lines = rows.select(
        "k1",
        "k2",
        F.col("doc_id").isNull().alias("no_id"),
        "doc_id",
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    ).withColumn("line", line_key(F.col("line")))
    return lines.filter(F.length("line") >= min_chars).select(
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
        "no_id",
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        "pos",
        "k1",
        "k2",
    )


def _first_occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order: the lines to drop (DROP), those of the partition's first hash, whose
    first document may lie in an earlier partition (OPEN), and where the last hash begins (LAST)."""
    run = None  # hash, document of the run that reached the end of the last batch
    opening = True
    for b in batches:
        if b.empty:
            continue
        h1, h2 = b["h1"].to_numpy(), b["h2"].to_numpy()
        doc, null = b["doc_id"].to_numpy(), b["no_id"].to_numpy(bool)
        begins = np.empty(len(b), bool)
        begins[0] = run is None or (h1[0], h2[0]) != run[0]
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.maximum.accumulate(np.where(begins, np.arange(len(b)), -1))
        first_doc, first_null = doc[at], null[at]
        if at[0] < 0:
            first_doc = np.where(at < 0, run[1][0], first_doc)
            first_null = np.where(at < 0, run[1][1], first_null)
        is_open = np.zeros(len(b), bool)
        if opening:
            after = np.flatnonzero(begins[1:] if run is None else begins)
            end = len(b) if not len(after) else after[0] + (run is None)
            is_open[:end] = True
            opening = end == len(b)
        drop = ((doc != first_doc) | (null != first_null)) & ~is_open
        run = ((h1[-1], h2[-1]), (first_doc[-1], bool(first_null[-1])))
        out = b[drop | is_open].copy()
        out.insert(0, "kind", np.where(is_open[drop | is_open], OPEN, DROP))
        yield out[["kind", "k1", "k2", "pos", "h1", "h2", "no_id", "doc_id"]]
    if run is not None:
        (h1, h2), (doc, null) = run
        yield pd.DataFrame(
            {"kind": [LAST], "k1": [0], "k2": [0], "pos": [0], "h1": [h1], "h2": [h2], "no_id": [null], "doc_id": [doc]}
        )


def dropped_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, pos) of the lines that an earlier document holds as well."""
    hashes = line_hashes(rows, min_chars)
    order = ["h1", "h2", "no_id", "doc_id", "pos"]
    width = shuffle_width(rows.sparkSession)
    ranged = hashes.repartitionByRange(width, *order).sortWithinPartitions(*order)
    schema = FOUND.format(id=dict(hashes.dtypes)["doc_id"])
    found = cut_lineage(ranged.mapInPandas(_first_occurrences, schema), "first-lines")
    # Per partition one LAST row and the OPEN rows of one hash, which shrink to one each
    # before the shuffle: as many rows as partitions, twice.
    firsts = (
        found.filter(F.col("kind") != DROP)
        .groupBy("h1", "h2")
        .agg(F.min(F.struct("no_id", "doc_id")).alias("first"))
    )
    opened = found.filter(F.col("kind") == OPEN).join(F.broadcast(firsts), ["h1", "h2"])
    late = opened.filter(F.struct("no_id", "doc_id") != F.col("first"))
    return (
        found.filter(F.col("kind") == DROP).select("k1", "k2", "pos").unionAll(late.select("k1", "k2", "pos"))
    )


@F.pandas_udf(BinaryType())
def _bitmap(n: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n_lines, positions):
        keep = np.ones(n_lines, np.uint8)
        if positions is not None:
            keep[np.asarray(positions, np.int64)] = 0
        return zlib.compress(np.packbits(keep).tobytes(), 1)

    return pd.Series([one(a, b) for a, b in zip(n, dropped, strict=True)], dtype=object)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per distinct (doc_id, text): k1, k2, doc_id, n_lines, n_dropped, keep_bitmap.

    Bit i (from the top of each byte, zlib) says whether line i stays.
    """
    rows = text_rows(docs)
    sizes = rows.select("k1", "k2", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    drops = dropped_lines(rows, min_chars).groupBy("k1", "k2").agg(F.collect_set("pos").alias("dropped"))
    return (
        sizes.dropDuplicates(["k1", "k2"])
        .join(drops, ["k1", "k2"], "left")
        .select(
            "k1",
            "k2",
            "doc_id",
            "n_lines",
            F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
            _bitmap("n_lines", "dropped").alias("keep_bitmap"),
        )
    )


@F.pandas_udf(StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t, b):
        if t is None:
            return None
        lines = t.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8))[: len(lines)]
        return "\n".join(x for x, k in zip(lines, keep, strict=True) if k)

    return pd.Series([one(a, b) for a, b in zip(text, bitmap, strict=True)], dtype=object)


def kept_text(text: Column, n_dropped: Column, bitmap: Column) -> Column:
    """The text that a bitmap leaves; only texts that lose a line go to Python."""
    changed = n_dropped > 0
    return F.when(~changed, text).otherwise(
        _kept(F.when(changed, text), F.when(changed, bitmap))
    )


def apply_line_dedup(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with its columns, ``text`` without the dropped lines (null stays null)."""
    joined = keyed_rows(docs).join(bitmaps.select("k1", "k2", "n_dropped", "keep_bitmap"), ["k1", "k2"])
    text = kept_text(F.col("row.text"), F.col("n_dropped"), F.col("keep_bitmap"))
    return joined.withColumn("_text", text).select(
        *(F.col("_text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns)
    )


def line_dedup_digests(docs: DataFrame) -> DataFrame:
    rows = text_rows(docs)
    bitmaps = line_dedup(docs).drop("doc_id")
    return rows.join(bitmaps, ["k1", "k2"]).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(kept_text(F.col("text"), F.col("n_dropped"), F.col("keep_bitmap")), 256).alias("kept_sha256"),
    )


SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, parts[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       LATERAL unnest(range(1, len(parts) + 1)) AS u(i)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT keyed.*, coalesce(first_id <> doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
