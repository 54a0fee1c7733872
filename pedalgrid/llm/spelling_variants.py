"""Spelling variants: words one letter apart, found through pairs of trie nodes.

Each word is a path in a trie of all words and, read backwards, in a trie of all reversed words. With the
nodes numbered, a pair (prefix node, suffix node) names a string with a hole exactly, in two integers:

* *skipped*: the node before a letter and the node behind it. Words that share such a pair differ in that letter.
* *inserted*: the nodes on both sides of a gap between letters. A word's inserted pair equals the skipped pair
  of each word that has one letter more in that gap.

So equal pairs give exactly the neighbours, without comparing strings. In a run of equal letters only the
last is a skipped position towards shorter words, so each pair of words meets once. A pair is shared
by one word per letter of the alphabet at most, and by one inserted word: no pair of nodes is hot. All that a word
wants to know of a pair (how many words, the most frequent one) are window aggregates over it.

Nodes are numbered in one stream over the sorted words: a word takes over the nodes of the prefix it shares
with the word before and numbers the rest on. Words are sorted by ranges; what the first words of a range share with the
range before is renumbered from two words per range.

Word ids ascend with falling counts, equal counts in code-point order, so that the least id is the best form. A form
has a higher count than its word: chains end, and roots come by doubling.

Defined results: null and empty texts hold no words; rows that repeat an id or a text count as often as they occur; with a null id no
letter is deleted from a run. Without words the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.llm.common import LOWER, UPPER
from pedalgrid.llm.merkle_manifest import CRC32_TABLE, crc32_sql
from pedalgrid.session import cut_lineage, shuffle_width

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans(UPPER, LOWER)
MIN_CHARS, MIN_COUNT, RATIO, DELETED = 7, 2, 10, 31
#: Different words a task holds before it hands on their counts.
HELD = 1 << 18
#: Node and row numbers of a range stay below this.
RANGE = 1 << 40


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, deleted: int | None = None) -> DataFrame:
    """(word, n) over all texts. With ``deleted``, a run whose CRC-32 (with the id before it) that number divides
    loses one letter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def handed_on() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(total), "n": list(total.values())})
            total.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                own: Counter = Counter()
                for raw, n in Counter(RUNS.findall(text)).items():
                    if len(raw) >= min_chars:
                        own[raw.translate(FOLD)] += n
                start = None if deleted is None or doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    if start is not None:
                        h = zlib.crc32(word.encode(), start)
                        if h % deleted == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_chars:
                                continue
                    total[word] += n
                if len(total) > HELD:
                    yield handed_on()
        if total:
            yield handed_on()

    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:  # a[:low] is shared
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _numbered(kept: list[str], nodes: str):
    """Streams sorted rows (part, key, kept columns) and adds the column ``nodes``: the numbers of the key's
    trie nodes by depth. The last row of a partition (no id) holds its first and last key, and the nodes of the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, path, used, first, part = "", np.empty(0, np.int64), 0, None, None
        for b in batches:
            if b.empty:
                continue
            if first is None:
                first, part = b["key"].iloc[0], b["part"].iloc[0]
            found = []
            for key in b["key"]:
                known = _shared(before, key)
                path = np.concatenate((path[:known], np.arange(used + 1, used + 1 + len(key) - known)))
                used += len(key) - known
                before = key
                found.append(path.tobytes())
            out = b[["part", *kept]].copy()
            out[nodes], out["first"], out["last"] = found, None, None
            yield out
        if first is not None:
            end = pd.DataFrame({"part": [part], **{c: [None] for c in kept}})
            end[nodes], end["first"], end["last"] = [path.tobytes()], [first], [before]
            yield end

    return run


def _global(local: np.ndarray, part: int, border: np.ndarray) -> np.ndarray:
    """Node numbers over all ranges. The numbers 1, 2, .. of a range are the prefixes of its first key; as far as
    the range before has them too, they are ``border``."""
    out = local + part * RANGE
    if len(border):
        shared = local <= len(border)
        out[shared] = border[local[shared] - 1]
    return out


def _borders(ends: DataFrame, nodes: str) -> DataFrame:
    """(part, border): two keys per range decide which nodes a range shares with the one before."""
    rows, before, path = [], None, None
    for e in sorted(ends.select("part", "first", "last", nodes).collect(), key=lambda e: e["part"]):
        shared = _shared(before, e["first"]) if before is not None else 0
        border = path[:shared] if shared else np.empty(0, np.int64)
        path = _global(np.frombuffer(e[nodes], np.int64), e["part"], border)
        before = e["last"]
        rows.append((e["part"], border.tobytes()))
    return ends.sparkSession.createDataFrame(rows, "part int, border binary")


def trie_numbers(words: DataFrame, key: str, nodes: str) -> DataFrame:
    """``words`` with the column ``nodes``: the numbers of the trie nodes on the path of column ``key``, eight bytes
    each. Equal prefixes have equal numbers, different prefixes different ones."""
    kept = [c for c in words.columns if c != key]
    types = dict(words.dtypes)
    ranged = words.withColumnRenamed(key, "key").repartitionByRange(shuffle_width(words.sparkSession), "key")
    rows = ranged.sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    columns = ", ".join(f"{c} {types[c]}" for c in kept)
    schema = f"part int, {columns}, {nodes} binary, first string, last string"
    found = cut_lineage(rows.mapInPandas(_numbered(kept, nodes), schema), "trie")
    borders = _borders(found.filter("first IS NOT NULL"), nodes)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[nodes] = [
                _global(np.frombuffer(x, np.int64), p, np.frombuffer(y, np.int64)).tobytes()
                for x, p, y in zip(b[nodes], b["part"], b["border"], strict=True)
            ]
            yield b[[*kept, nodes]]

    inner = found.filter("first IS NULL").drop("first", "last").join(borders, "part")
    return inner.mapInPandas(whole, f"{columns}, {nodes} binary")


def _letters(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32)


SKIPPED, LAST_OF_RUN, INSERTED = 0, 1, 2


def node_pairs(words: DataFrame) -> DataFrame:
    """(p, s, kind, id): the skipped and inserted pairs of ``words`` (id, word, front, back). LAST_OF_RUN is
    a skipped pair that also leads to a shorter word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made, size = [], 0
            for i, word, front, back in zip(b["id"], b["word"], b["front"], b["back"], strict=True):
                front = np.concatenate(([0], np.frombuffer(front, np.int64)))
                back = np.concatenate(([0], np.frombuffer(back, np.int64)))[::-1]
                letters = _letters(word)
                kind = np.full(2 * len(word) + 1, INSERTED, np.int8)
                kind[: len(word)] = LAST_OF_RUN
                kind[: len(word) - 1][letters[1:] == letters[:-1]] = SKIPPED
                made.append((np.concatenate((front[:-1], front)), np.concatenate((back[1:], back)), kind, np.full(len(kind), i)))
                size += len(kind)
                if size > HELD:
                    yield pd.DataFrame(dict(zip("p s kind id".split(), map(np.concatenate, zip(*made, strict=True)), strict=True)))
                    made, size = [], 0
            if made:
                yield pd.DataFrame(dict(zip("p s kind id".split(), map(np.concatenate, zip(*made, strict=True)), strict=True)))

    return words.select("id", "word", "front", "back").mapInPandas(run, "p long, s long, kind byte, id long")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are one letter away, and the least id among those before ``id``, if any."""
    pair = W.partitionBy("p", "s")
    is_skip, is_last, is_in = F.col("kind") != INSERTED, F.col("kind") == LAST_OF_RUN, F.col("kind") == INSERTED

    def over(test, name):
        return {
            f"n_{name}": F.count(F.when(test, 1)).over(pair),
            f"id_{name}": F.min(F.when(test, F.col("id"))).over(pair),
        }

    met = pairs.withColumns(over(is_skip, "skip") | over(is_last, "last") | over(is_in, "in"))
    near = (
        F.when(is_in, F.col("n_last")).when(is_last, F.col("n_skip") - 1 + F.col("n_in")).otherwise(F.col("n_skip") - 1)
    )
    least = F.when(is_in, F.col("id_last")).when(is_last, F.least("id_skip", "id_in")).otherwise(F.col("id_skip"))
    better = F.when(least < F.col("id"), least)
    return met.select("id", near.alias("near"), better.alias("better")).groupBy("id").agg(
        F.sum("near").alias("n_near"), F.min("better").alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms`` (id, form): where following forms ends."""
    hops = cut_lineage(forms.select("id", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not hops.filter("moved").isEmpty():
        further = hops.select(F.col("id").alias("root"), F.col("root").alias("then"))
        hops = cut_lineage(
            hops.join(further, "root", "left").select(
                "id", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")
            ),
            "forms",
        )
    return hops.select("id", "root")


def spelling_variants(counts: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) per word of ``counts`` (word, n) with ``min_count`` or more."""
    frequent = counts.filter(F.col("n") >= min_count)
    order = [F.col("n").desc(), F.col("word").asc()]
    ranged = frequent.repartitionByRange(shuffle_width(counts.sparkSession), *order).sortWithinPartitions(*order)
    words = cut_lineage(ranged.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    front = trie_numbers(words.select("id", "word", F.col("word").alias("key")), "key", "front")
    both = trie_numbers(front.withColumn("key", F.reverse("word")), "key", "back")
    near = neighbours(node_pairs(both))
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = cut_lineage(words.join(near, "id").join(best, "best", "left"), "neighbours")
    fits = F.coalesce(F.col("form_n") >= F.col("n") * ratio, F.lit(False))
    roots = _roots(found.filter(fits).select("id", F.col("best").alias("form")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    return found.join(named.select("id", "root_word"), "id", "left").select(
        "word",
        "n",
        "n_near",
        F.when(fits, F.col("form")).alias("form"),
        F.when(fits, F.col("form_n")).alias("form_n"),
        F.coalesce("root_word", "word").alias("root"),
    )


def spelling_digests(docs: DataFrame) -> DataFrame:
    return spelling_variants(word_counts(docs, deleted=DELETED))


SQL = f"""
WITH RECURSIVE {CRC32_TABLE},
runs AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {MIN_CHARS}),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT *, {crc32_sql("doc_id || ':' || run")} AS h FROM counted, crc_table),
words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (
    SELECT c, CASE WHEN h % {DELETED} = 0
      THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
holes AS (
  SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS z
  FROM words, LATERAL unnest(range(length(word))) AS u(i)),
shorter AS (SELECT DISTINCT word, n, a || z AS other FROM holes),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM holes x JOIN holes y USING (i, a, z) WHERE x.word <> y.word
  UNION ALL
  SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON w.word = s.other
  UNION ALL
  SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON w.word = s.other),
best AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place
  FROM near),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN other END AS form,
    CASE WHEN m >= {RATIO} * n THEN m END AS form_n
  FROM words LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (word)),
chain AS (
  SELECT word, word AS step, 0 AS i FROM words
  UNION ALL
  SELECT chain.word, form, i + 1 FROM chain JOIN formed ON formed.word = chain.step WHERE form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root
FROM formed JOIN (SELECT word, arg_max(step, i) AS root FROM chain GROUP BY word) USING (word)
"""
