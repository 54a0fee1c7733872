"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

*MinHash by size class.* Items with 2^c to 2^(c+1) - 1 distinct shingles are a class. For each class a document is
cut into windows of two blocks of 2^(c+1) shingles, one block apart, so that a passage as long as an item lies whole in
one, and a window is at most four times an item. Of the document's shingles only those that some item has
count, which brings sets closer to each other. A window that holds ``share`` = 0.75 of an item then has a
similarity of 0.75 / 4.25 or more with it and agrees in one of ``HASHES`` = 48 minima but for one time in 10,000. Items and windows
with a common minimum are candidates; a bit table of the items' minima keeps all others out of the shuffle.

*Exact rest.* What no window holds whole (the pieces of an item spread over a long document) and what chance
misses is found by rare shingles: a document that holds ``need`` of an item's n shingles holds at least one of any
n - need + 1 of them, so every item is looked up by that many of its shingles, those that the fewest documents hold.

Candidates of both are verified: the share of the item's distinct shingles in the whole document must reach ``share``;
shingles are compared as 64-bit hashes. ``by_minhash`` says which pairs the classes found.

Defined results: items and documents without words match nothing; one with fewer words than a shingle
has a single shingle, its whole text. Items that repeat an id count each text for itself; null item ids
are kept. Repeated documents are reported each. Empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pedalgrid.llm.common import (
    FILTER_BITS,
    join_wanted,
    keyed_rows,
    mix64,
    shingle_hashes,
    sorted_unique,
    text_groups,
    text_rows,
)
from pedalgrid.session import cut_lineage

SHARE = 0.75
#: Minima per window and item.
HASHES = 48
_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(32))


def looked_up(n: int, share: float) -> int:
    """How many of an item's ``n`` shingles must be looked up so that no pair is missed."""
    return max(0, n - max(1, int(np.ceil(share * n))) + 1)


def item_rows(items: DataFrame) -> DataFrame:
    """(item_id, n, shingles as bytes), one row per item with words."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for a, z in text_groups(texts):
                hashes, at, _ = shingle_hashes(texts[a:z])
                rows = []
                for i in range(z - a):
                    own = sorted_unique(hashes[at[i] : at[i + 1]])
                    if len(own):
                        rows.append((b["item_id"].iloc[a + i], len(own), own.tobytes()))
                yield pd.DataFrame(rows, columns=["item_id", "n", "shingles"])

    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    schema = "item_id string, n long, shingles binary"
    return named.mapInPandas(run, schema).withColumn("item_id", F.col("item_id").cast(kind))


def item_shingles(items: DataFrame, share: float) -> DataFrame:
    """(item, shingle, most): a row per shingle, and how many of them are to be looked up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, n, shingles in zip(b["item"], b["n"], b["shingles"], strict=True):
                yield pd.DataFrame({"item": item, "shingle": np.frombuffer(shingles, np.int64), "most": looked_up(n, share)})

    return items.select("item", "n", "shingles").mapInPandas(run, "item long, shingle long, most long")


def bit_table(shingles: DataFrame) -> np.ndarray:
    """Which places the shingles take: at most ``FILTER_BITS / 64`` rows reach the driver."""
    place = F.col("shingle").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = shingles.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")
    )
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    for word, value in words.collect():
        table[word] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)
    return table


def text_shingles(texts: list[str], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, shingle): the distinct shingles of each text that pass the bit table."""
    for a, z in text_groups(texts):
        hashes, at, _ = shingle_hashes(texts[a:z])
        place = hashes & np.uint64(FILTER_BITS - 1)
        hit = np.flatnonzero((table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
        if len(hit):
            owner = np.searchsorted(at, hit, side="right") - 1
            order = np.lexsort((hashes[hit], owner))
            owner, found = owner[order], hashes[hit][order]
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])))
            yield a + owner[new], found[new].view(np.int64)


def rare_shingles(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(item, shingle): of each item the ``most`` shingles that the fewest documents hold, less those in none."""
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(entries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, found in text_shingles(b["text"].tolist(), shared.value):
                values, n = np.unique(found, return_counts=True)
                yield pd.DataFrame({"shingle": values, "held": n})

    held = rows.select("text").mapInPandas(run, "shingle long, held long").groupBy("shingle").agg(F.sum("held").alias("held"))
    rarest = W.partitionBy("item").orderBy(F.coalesce("held", F.lit(0)), "shingle")
    ranked = entries.join(held, "shingle", "left").withColumn("rank", F.row_number().over(rarest))
    return ranked.filter("rank <= most AND held IS NOT NULL").select("item", "shingle")


def _names(minima: np.ndarray, size_class: int, which: int) -> np.ndarray:
    """One number for a minimum of a class and a hash function."""
    return mix64(minima + np.uint64(size_class * HASHES + which) * np.uint64(0x9E3779B97F4A7C15))


def item_minima(items: DataFrame) -> DataFrame:
    """(item, size_class, shingle): the named minima of each item, ``HASHES`` of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, shingles in zip(b["item"], b["shingles"], strict=True):
                own = np.frombuffer(shingles, np.uint64)
                c = len(own).bit_length() - 1
                names = [_names(mix64(own ^ s).min(keepdims=True), c, j) for j, s in enumerate(_SEEDS)]
                yield pd.DataFrame({"item": item, "size_class": c, "shingle": np.concatenate(names).view(np.int64)})

    return items.select("item", "shingles").mapInPandas(run, "item long, size_class int, shingle long")


def window_minima(hashes: np.ndarray, owner: np.ndarray, place: np.ndarray, classes: list[int]):
    """(text, name) of the minima of all windows, for shingles sorted by text and place."""
    mixed = [mix64(hashes ^ s) for s in _SEEDS]
    for c in classes:
        block = place >> (c + 1)
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])))
        start = np.flatnonzero(new)
        text, at = owner[start], block[start]
        joins = np.concatenate(((text[1:] == text[:-1]) & (at[1:] == at[:-1] + 1), [False]))  # with the next block
        alone = ~np.concatenate(([False], joins[:-1]))  # the window that ends here has no other block
        for j, values in enumerate(mixed):
            least = np.minimum.reduceat(values, start)
            pair = least.copy()
            pair[joins] = np.minimum(least[joins], least[1:][joins[:-1]])
            yield np.concatenate((text, text[alone])), _names(np.concatenate((pair, least[alone])), c, j)


def minhash_candidates(rows: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """(k1, k2, item): pairs of an item and a document with a window that shares a minimum."""
    minima = cut_lineage(item_minima(items), "item-minima")
    classes = sorted(r[0] for r in minima.select("size_class").distinct().collect())  # 64 at most
    spark = rows.sparkSession.sparkContext
    known, wanted = spark.broadcast(bit_table(entries)), spark.broadcast(bit_table(minima))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = np.uint64(FILTER_BITS - 1)

        def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
            place = values & mask
            return ((table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)

        for b in batches:
            texts = b["text"].tolist()
            k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
            for a, z in text_groups(texts):
                hashes, at, _ = shingle_hashes(texts[a:z])
                hit = np.flatnonzero(passes(known.value, hashes))
                if not len(hit):
                    continue
                owner = np.searchsorted(at, hit, side="right") - 1
                found = []
                for text, name in window_minima(hashes[hit], owner, hit - at[owner], classes):
                    keep = passes(wanted.value, name)
                    found.append((text[keep], name[keep]))
                text, name = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"k1": k1[a + text], "k2": k2[a + text], "shingle": name.view(np.int64)}).drop_duplicates()

    hits = rows.select("k1", "k2", "text").mapInPandas(run, "k1 long, k2 long, shingle long")
    return hits.join(minima.select("shingle", "item"), "shingle").select("k1", "k2", "item").distinct()


def rest_candidates(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(k1, k2, item): pairs that share a rare shingle."""
    wanted = cut_lineage(rare_shingles(rows, entries), "rare-shingles")
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
            for text, found in text_shingles(b["text"].tolist(), shared.value):
                yield pd.DataFrame({"k1": k1[text], "k2": k2[text], "shingle": found})

    hits = rows.select("k1", "k2", "text").mapInPandas(run, "k1 long, k2 long, shingle long")
    return hits.join(wanted, "shingle").select("k1", "k2", "item").distinct()


def candidates(rows: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(k1, k2, item, by_minhash). ``items`` from :func:`item_rows`, numbered."""
    entries = cut_lineage(item_shingles(items, share), "item-shingles")
    close = minhash_candidates(rows, items, entries).withColumn("by_minhash", F.lit(True))
    rest = rest_candidates(rows, entries).withColumn("by_minhash", F.lit(False))
    return close.unionAll(rest).groupBy("k1", "k2", "item").agg(F.max("by_minhash").alias("by_minhash"))


def contamination(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(k1, k2, doc_id, item_id, n_item, n_shared, containment, by_minhash) of every contaminated pair."""
    numbered = item_rows(items).withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "shingles"))
    known = cut_lineage(numbered, "items").dropDuplicates(["item"])
    rows = text_rows(docs)
    found = cut_lineage(candidates(rows, known, share), "item-candidates")
    asked = (
        found.join(known.select("item", "n", "shingles"), "item")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("item", "n", "shingles")).alias("asked"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for a, z in text_groups(texts):
                hashes, at, _ = shingle_hashes(texts[a:z])
                out = []
                for i in range(a, z):
                    own = hashes[at[i - a] : at[i - a + 1]]
                    for q in b["asked"].iloc[i]:
                        wanted = np.frombuffer(q["shingles"], np.uint64)
                        both = int(np.isin(wanted, own).sum())
                        if both >= share * len(wanted):
                            out.append((b["k1"].iloc[i], b["k2"].iloc[i], b["doc_id"].iloc[i], q["item"], len(wanted), both))
                yield pd.DataFrame(out, columns=["k1", "k2", "doc_id", "item", "n_item", "n_shared"])

    kind = dict(docs.dtypes)["doc_id"]
    checked = (
        join_wanted(rows.withColumn("doc_id", F.col("doc_id").cast("string")), asked)
        .mapInPandas(run, "k1 long, k2 long, doc_id string, item long, n_item long, n_shared long")
        .withColumn("doc_id", F.col("doc_id").cast(kind))
    )
    named = checked.join(known.select("item", "item_id"), "item").join(found, ["k1", "k2", "item"])
    share_of = (F.col("n_shared") / F.col("n_item")).alias("containment")
    return named.select("k1", "k2", "doc_id", "item_id", "n_item", "n_shared", share_of, "by_minhash")


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that hold an item, with its own columns."""
    leaked = contamination(docs, items, share).select("k1", "k2").distinct()
    return keyed_rows(docs).join(leaked, ["k1", "k2"], "left_anti").select("row.*")


#: Brute force over all pairs that share a shingle.
SQL = """
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ') AS w
  FROM documents
  UNION ALL
  SELECT 'i', item_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ')
  FROM benchmark),
shingles AS (
  SELECT DISTINCT side, id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS s
  FROM words, LATERAL unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i)
  WHERE array_to_string(w, '') <> ''),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE side = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.side = 'd' AND i.side = 'i' AND d.s = i.s GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes ON sizes.id = item_id WHERE n_shared >= 0.75 * n_item
"""
