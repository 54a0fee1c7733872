"""Removal of long repeated byte strings, by run-compressed Burrows-Wheeler indexes.

Every string of ``length`` bytes owns the least of its GRAM-byte pieces under a hash (its anchor). Equal
strings own equal anchors, so the search splits by anchor: a segment is the text of consecutive
strings with the same anchor, and only segments with equal anchors can share a string.

1. Texts are cut into segments; a segment is known by hashes of its anchor and of its bytes. Anchors that
   occur once are dropped, equal segments are counted before the shuffle. All strings of a segment that
   occurs twice or more are repeated.
2. What is left, once per distinct segment, goes to its anchor's group with its bytes. For a block of groups the
   Burrows-Wheeler transform of the concatenated segments is built and run-compressed. Suffix
   positions and the lengths of the matches with the neighbouring suffixes are taken at run ends only
   (inside a run they follow from the position before). Streaming these through the text gives
   every position's matching statistic: the longest match that occurs elsewhere. Matches of
   ``length`` bytes mark the strings that repeat.
3. Groups larger than ``largest`` are divided exactly: each string is sent to its own hash.

Marks return to the segments and are joined to whole texts. Strings are judged on the input.

Defined results: texts are UTF-8 bytes, null is empty. Matches never cross texts. Repeated rows are
documents of their own, hence repeat each other. A text shorter than ``length`` keeps all bytes. Kept
bytes need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalgrid.llm.common import asked_for, join_wanted, piece_hash, prefix_hash, text_groups, text_rows
from pedalgrid.session import cut_lineage, shuffle_width

LENGTH, GRAM = 400, 64
#: Bytes of one index of several groups, and of the largest group that gets one; larger groups are
#: divided. An index takes about 100 bytes of memory per byte.
BLOCK, LARGEST = 1 << 20, 1 << 22
#: Bytes of a text handled at once.
PIECE = 1 << 21


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the least, the first of equals."""
    n = len(values)
    windows = n - width + 1
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = (values & ~low) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    return (least & low).astype(np.int64)


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor hash): runs of string starts with one anchor, in one text."""
    sums = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = piece_hash(sums, at, at + gram)
    own = sliding_argmin(hashes, length - gram + 1)
    edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return edge, np.append(edge[1:], len(own)) - 1, hashes[own[edge]]


def _pieces(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in parts that overlap by less than a string, so each string is in one part."""
    for a in range(0, len(data) - length + 1, PIECE):
        yield a, data[a : a + PIECE + length - 1]


SEGMENTS = "k1 long, k2 long, start long, size int, anchor long, s1 long, s2 long"


def _cut(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
            for a, z in text_groups(texts):
                out = []
                for i in range(a, z):
                    raw = texts[i].encode("utf-8", "surrogatepass")
                    data = np.frombuffer(raw, np.uint8)
                    for shift, part in _pieces(data, length):
                        first, last, anchor = segments(part, length, gram)
                        for s, e, h in zip((first + shift).tolist(), (last + shift).tolist(), anchor.view(np.int64).tolist(), strict=True):
                            x = xxhash.xxh3_128_intdigest(raw[s : e + length])
                            out.append((k1[i], k2[i], s, e + length - s, h, (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)))
                yield pd.DataFrame(out, columns=["k1", "k2", "start", "size", "anchor", "s1", "s2"])

    return run


def suffix_array(words: np.ndarray, room: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling from eight bytes on.

    ``words[i]`` holds the eight bytes from i on, ``room[i]`` how many bytes segment ``owner[i]`` still has.
    A suffix that ends within the bytes compared is told apart by its segment. A rank is the
    first slot of the suffixes not yet told apart; only these are sorted again.
    """
    n = len(room)
    near = room < 8
    gone = np.minimum((8 - np.minimum(room, 8)) * 8, 63).astype(np.uint64)
    first = np.where(near, (words[:n] >> gone) << gone, words[:n])
    first[room == 0] = 0
    segments = int(owner[-1]) + 1
    tail = np.where(near, (room - 8) * segments + owner - segments, 0)  # an end sorts before any byte
    tail = tail.astype(np.int32)
    order = np.lexsort((tail, first)).astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = (first[order[1:]] != first[order[:-1]]) | (tail[order[1:]] != tail[order[:-1]])
    del first, tail, gone, near
    step = 8
    slots = np.arange(n, dtype=np.int32)
    while True:
        begin = np.maximum.accumulate(np.where(new, slots, np.int32(0)))
        rank = np.empty(n, np.int32)
        rank[order] = begin
        alone = new & np.append(new[1:], True)
        todo = np.flatnonzero(~alone)
        if not len(todo):
            return order
        own = order[todo]
        # these suffixes have more than ``step`` bytes left, or they would stand alone
        key = begin[todo].astype(np.int64) * (n + 1) + rank[np.minimum(own + step, n - 1)]
        moved = np.argsort(key, kind="stable")
        order[todo] = own[moved]
        key = key[moved]
        new[todo[1:]] |= key[1:] != key[:-1]
        step *= 2


def common_prefix(words: np.ndarray, limit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the match of the texts at ``a`` and ``b``, both within their segments.

    ``words[i]`` holds the eight bytes from i on.
    """
    most = np.minimum(limit[a] - a, limit[b] - b).astype(np.int64)
    out = most.copy()
    todo = np.flatnonzero(most > 0)
    done = 0
    while len(todo):
        x = words[a[todo] + done] ^ words[b[todo] + done]
        stop = x != 0
        ended = todo[stop]
        if len(ended):
            differ = x[stop]
            first = sum((differ >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
            out[ended] = np.minimum(most[ended], done + first)
        done += 8
        todo = todo[~stop]
        todo = todo[most[todo] > done]
    return out


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some segments, sampled at run ends."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts])
        #: Segments follow each other with an end mark of their own, which matches nothing.
        self.start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        self.ends = self.start + sizes
        raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        self.n = len(raw)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + 1)
        self.limit = self.ends.astype(np.int32)[owner]
        padded = np.concatenate((raw, np.zeros(16, np.uint8)))
        words = np.zeros(self.n + 8, np.uint64)
        for j in range(8):
            words |= padded[j : j + self.n + 8].astype(np.uint64) << np.uint64(56 - 8 * j)
        order = suffix_array(words, self.limit - np.arange(self.n, dtype=np.int32), owner)
        codes = raw.astype(np.int32) + len(parts)
        codes[self.ends] = np.arange(len(parts))
        before = np.where(order > 0, codes[order - 1], -1)
        ends = before[1:] != before[:-1]
        #: Run-length form of the transform, and the suffix positions on both sides of each border.
        heads = np.flatnonzero(np.concatenate(([True], ends)))
        self.symbols, self.lengths = before[heads], np.diff(np.append(heads, self.n))
        border = heads[1:]
        self.left, self.right = order[border - 1], order[border]
        self.shared = common_prefix(words, self.limit, self.left, self.right)

    def matching_statistics(self) -> np.ndarray:
        """For every position the length of its longest match that occurs elsewhere.

        Inside a run a suffix and its neighbour are both preceded by the same byte, so the match of
        the position before is one longer: only run ends carry a new length.
        """
        place = np.arange(self.n, dtype=np.int32)
        out = np.zeros(self.n, np.int32)
        for sample in (self.left, self.right):
            reach = np.zeros(self.n, np.int32)
            np.maximum.at(reach, sample, (self.shared + sample).astype(np.int32))
            out = np.maximum(out, np.maximum.accumulate(reach) - place)
        return np.minimum(out, self.limit - place)


def repeated_runs(parts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each segment the ranges (from, to) of string starts that occur elsewhere among ``parts``."""
    index = RunIndex(parts)
    hit = index.matching_statistics() >= length
    out = []
    for a, z in zip(index.start, index.ends, strict=True):
        edge = np.diff(np.concatenate(([False], hit[a:z], [False])).astype(np.int8))
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)))
    return out


MARKS = "anchor long, s1 long, s2 long, lo int, hi int"


def _index_groups(length: int, block: int):
    """Indexes over blocks of whole groups; rows come sorted by anchor."""

    def marks(held: list) -> pd.DataFrame:
        out = []
        if len(held) > 1:
            for (anchor, s1, s2, _), runs in zip(held, repeated_runs([h[3] for h in held], length), strict=True):
                out += [(anchor, s1, s2, lo, hi) for lo, hi in runs]
        return pd.DataFrame(out, columns=["anchor", "s1", "s2", "lo", "hi"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last, group = [], 0, None, []
        for b in batches:
            for row in zip(b["anchor"], b["s1"], b["s2"], b["bytes"], strict=True):
                if row[0] != last and group:
                    if size + sum(len(g[3]) for g in group) > block and held:
                        yield marks(held)
                        held, size = [], 0
                    held += group
                    size += sum(len(g[3]) for g in group)
                    group = []
                last = row[0]
                group.append(row)
        if held or group:
            yield marks(held + group)

    return run


def repeated_segments(
    rows: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, largest: int = LARGEST
) -> DataFrame:
    """(k1, k2, lo, hi): ranges of string starts that occur elsewhere."""
    cuts = cut_lineage(rows.select("k1", "k2", "text").mapInPandas(_cut(length, gram), SEGMENTS), "segments")
    often = cuts.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    often = cut_lineage(often, "anchors")  # a join of two plain tables can be split where one anchor is hot
    found = cut_lineage(cuts.join(often, "anchor"), "shared-anchors")
    where = F.struct("k1", "k2", "start")
    distinct = cut_lineage(
        found.groupBy("anchor", "s1", "s2").agg(F.count("*").alias("c"), F.min(where).alias("at"), F.max("size").alias("size")),
        "distinct-segments",
    )
    groups = distinct.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.min("c").alias("least"), F.sum("size").alias("bytes")
    )
    # A group needs an index if it has a segment that occurs once, and another one to match.
    open_groups = groups.filter("kinds > 1 AND least = 1").select("anchor", (F.col("bytes") > largest).alias("large"))
    open_groups = cut_lineage(open_groups, "open-groups")
    asked = distinct.join(open_groups, "anchor")
    per_text = asked.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
        F.collect_list(F.struct("anchor", "s1", "s2", F.col("at.start").alias("start"), "size", "large", "c")).alias("asked")
    )
    texts = join_wanted(rows.select("k1", "k2", "text"), per_text).dropDuplicates(["k1", "k2"])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, asked in zip(b["text"], b["asked"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out = [(p["anchor"], p["s1"], p["s2"], bool(p["large"]), p["c"], raw[p["start"] : p["start"] + p["size"]]) for p in asked]
                yield pd.DataFrame(out, columns=["anchor", "s1", "s2", "large", "c", "bytes"])

    fetched = cut_lineage(
        texts.select("text", "asked").mapInPandas(fetch, "anchor long, s1 long, s2 long, large boolean, c long, bytes binary"),
        "segment-bytes",
    )
    small = fetched.filter("NOT large").select("anchor", "s1", "s2", "bytes")
    indexed = (
        small.repartition(shuffle_width(rows.sparkSession), "anchor")
        .sortWithinPartitions("anchor")
        .mapInPandas(_index_groups(length, block), MARKS)
    )

    def each_string(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for anchor, s1, s2, c, raw in zip(b["anchor"], b["s1"], b["s2"], b["c"], b["bytes"], strict=True):
                at = np.arange(len(raw) - length + 1)
                sums = prefix_hash(np.frombuffer(raw, np.uint8))
                first = piece_hash(sums, at, at + length)
                second = piece_hash(prefix_hash(np.frombuffer(raw, np.uint8)[::-1]), len(raw) - at - length, len(raw) - at)
                yield pd.DataFrame(
                    {"anchor": anchor, "s1": s1, "s2": s2, "lo": at, "u": first.view(np.int64), "v": second.view(np.int64), "c": c}
                )

    strings = (
        fetched.filter("large")
        .select("anchor", "s1", "s2", "c", "bytes")
        .mapInPandas(each_string, "anchor long, s1 long, s2 long, lo int, u long, v long, c long")
    )
    twice = strings.groupBy("anchor", "u", "v").agg(F.sum("c").alias("all")).filter("all > 1").select("anchor", "u", "v")
    divided = strings.join(twice, ["anchor", "u", "v"]).select("anchor", "s1", "s2", "lo", (F.col("lo") + 1).alias("hi"))
    marks = indexed.unionByName(divided).groupBy("anchor", "s1", "s2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    whole = distinct.filter("c > 1").select(
        "anchor", "s1", "s2", F.array(F.struct(F.lit(0).alias("lo"), (F.col("size") - length + 1).cast("int").alias("hi"))).alias("runs")
    )
    once = marks.join(distinct.filter("c = 1").select("anchor", "s1", "s2"), ["anchor", "s1", "s2"])
    known = cut_lineage(whole.unionByName(once), "marks")
    return (
        found.join(known, ["anchor", "s1", "s2"])
        .select("k1", "k2", "start", F.explode("runs").alias("r"))
        .select("k1", "k2", (F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi")).alias("hi"))
    )


def merged(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs of ranges of string starts."""
    order = np.argsort(lo, kind="stable")
    a, z = lo[order], hi[order] - 1 + length
    reach = np.maximum.accumulate(z)
    new = np.concatenate(([True], a[1:] > reach[:-1]))
    edge = np.flatnonzero(new)
    return a[edge], reach[np.append(edge[1:], len(a)) - 1]


KEPT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary"


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    block: int = BLOCK,
    largest: int = LARGEST,
    digest: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept``, the remaining bytes (or their SHA-256)."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = text_rows(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    spans = repeated_segments(rows, length, gram, block, largest)
    per_text = cut_lineage(
        spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "repeats"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, spans in zip(b["doc_id"], b["text"], b["spans"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if spans is None:
                    out.append((doc_id, len(raw), 0, 0, hashlib.sha256(raw).digest() if digest else raw))
                    continue
                a, z = merged(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]), length)
                inner = zip([0, *z.tolist()], [*a.tolist(), len(raw)], strict=True)
                kept = b"".join(raw[x:y] for x, y in inner)
                out.append((doc_id, len(raw), int((z - a).sum()), len(a), hashlib.sha256(kept).digest() if digest else kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    test, tested = asked_for(rows, per_text.select("k1", "k2"))
    raw = F.encode("text", "utf-8")
    kept = F.unhex(F.sha2("text", 256)) if digest else raw
    zero = F.lit(0).cast("long")
    untouched = tested.filter(~test).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        kept.alias("kept"),
    )
    joined = tested.filter(test).join(per_text, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    done = untouched.unionAll(joined.mapInPandas(run, KEPT))
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def repeat_digests(docs: DataFrame) -> DataFrame:
    return without_repeats(docs, digest=True).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256")
    )


#: All strings of the whole table by their hash.
SQL = f"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (
  SELECT doc_id, b, len(h) // 2 - {LENGTH - 1} AS n, substr(h, 2 * b + 1, {2 * (512 + LENGTH)}) AS part
  FROM raw, LATERAL unnest(range(0, greatest(len(h) // 2 - {LENGTH - 1}, 0), 512)) AS u(b)),
strings AS (
  SELECT doc_id, i, md5(substr(part, 2 * (i - b) + 1, {2 * LENGTH})) AS s
  FROM parts, LATERAL unnest(range(b, least(b + 512, n))) AS u(i)),
twice AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM strings SEMI JOIN twice USING (s)),
numbered AS (
  SELECT doc_id, i, sum(apart) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, CAST(coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH}, TRUE) AS INTEGER)
      AS apart FROM hits)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS z FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM (
    SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, len(h) // 2, NULL FROM raw)),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a, upto) AS k
  FROM pieces JOIN raw USING (doc_id) GROUP BY doc_id),
totals AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM raw JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)
"""
