"""Jaccard join of word shingle sets, by adaptive prefixes that must share several tokens.

Tokens (shingles) are in one global order, rare before frequent. Two sets with similarity t share at
least l of their first ``n - ceil(t n) + l`` tokens. Every document chooses its own l: a longer
prefix has more postings but asks for more shared tokens, so it pays where the estimated number
of candidates is high; a pair needs the smaller l of its two documents. Frequencies come from a
count sketch over all tokens, of fixed size, which is all that is sent to the tasks.

1. Equal sets become one node. One pass makes set signatures and the sketch.
2. Prefix tokens are packed by token range into arrays; tokens that only one node holds are dropped
   there. Tokens that the sketch knows as hot skip this step, so no task gathers a hot token.
3. Long posting lists: rounds link their nodes to one leader per list, first to the node most of whose tokens
   others hold, then to such a node outside the list's largest component, until a round links hardly any more. That
   contracts groups of near copies without comparing all their pairs.
4. Exact rest: all pairs of a posting list that are still in different components, where the token can be among
   the first l that the two share: sets of n1 and n2 tokens share O = ceil(t (n1 + n2) / (1 + t)) or more, so the
   l-th shared one lies at place n - O + l of either set or before. A pair with l such tokens is verified on whole sets.
   Lists with one component left emit nothing; a list's largest component is never paired with
   itself. No list is capped.

Shingles are compared as 64-bit hashes.

Defined results: a text without words has an empty set, is linked with nothing and is its own
component; with fewer words than a shingle the whole sequence is one. Rows that repeat an id are documents
of their own with that id. A null id takes part and comes after all others as component id.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedalgrid.llm.common import (
    join_wanted,
    keyed_rows,
    shingle_hashes,
    small_batches,
    sorted_unique,
    text_groups,
    text_rows,
)
from pedalgrid.llm.components import components
from pedalgrid.session import cut_lineage, forget, shuffle_width

SIMILARITY = Fraction(3, 4)
#: Counters of the frequency sketch (8 bytes each where it is broadcast), and of a stored piece.
SKETCH, PIECE = 1 << 20, 1 << 10
#: Least and largest l (short sets have less); postings that one verified candidate costs as much as.
LEAST_SHARED, MOST_SHARED, CANDIDATE_COST = 1, 4, 8.0
#: Lists this long go through leader rounds, this many at most (the rest decides); tokens this frequent are hot.
LONG, ROUNDS, HOT = 16, 3, 4096
#: A round that links less than this share of all links so far is the last.
WORTH = 0.02
PACKED = 1 << 19


def _sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, z in text_groups(texts):
        hashes, at, _ = shingle_hashes(texts[a:z])
        for i in range(z - a):
            yield sorted_unique(hashes[at[i] : at[i + 1]])


def _signature(own: np.ndarray, seed: int) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(own.tobytes(), seed)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


SIGNED = "k1 long, k2 long, node long, check long, n long, piece int, counts binary"


def signatures(rows: DataFrame, seed: int) -> DataFrame:
    """A row (k1, k2, node, check, n) per text, and rows (piece, counts) of the sketch per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(SKETCH, np.uint32)
        for b in batches:
            out = []
            for own in _sets(b["text"].tolist()):
                np.add.at(sketch, (own >> np.uint64(44)).astype(np.int64), 1)
                out.append((*_signature(own, seed), len(own)))
            made = pd.DataFrame(out, columns=["node", "check", "n"])
            made.insert(0, "k1", b["k1"].to_numpy())
            made.insert(1, "k2", b["k2"].to_numpy())
            made["piece"], made["counts"] = -1, None
            yield made
        pieces = sketch.reshape(-1, PIECE)
        used = np.flatnonzero(pieces.any(axis=1))
        if len(used):
            yield pd.DataFrame(
                {"k1": 0, "k2": 0, "node": 0, "check": 0, "n": 0, "piece": used, "counts": [pieces[i].tobytes() for i in used]}
            )

    return rows.select("k1", "k2", "text").mapInPandas(run, SIGNED)


def frequencies(pieces: DataFrame) -> np.ndarray:
    """The sketch summed over all tasks: SKETCH counters, whatever the size of the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b["piece"], b["counts"], strict=True):
                if i not in total:
                    total[i] = np.zeros(PIECE, np.uint64)
                total[i] += np.frombuffer(c, np.uint32)
        yield pd.DataFrame({"piece": list(total), "counts": [c.tobytes() for c in total.values()]})

    summed = pieces.repartition("piece").mapInPandas(run, "piece int, counts binary")
    sketch = np.zeros(SKETCH, np.uint64)
    for i, c in summed.collect():
        sketch[i * PIECE : (i + 1) * PIECE] = np.frombuffer(c, np.uint64)
    return sketch


def prefix(own: np.ndarray, sketch: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, frequencies, l): the prefix of a set in the global order, (frequency, hash), of adaptive length."""
    n = len(own)
    often = sketch[(own >> np.uint64(44)).astype(np.int64)]
    order = np.lexsort((own, often))
    tokens, often = own[order], often[order]
    least = -(-SIMILARITY.numerator * n // SIMILARITY.denominator)
    shortest = n - least
    most = min(MOST_SHARED, least)
    excess = np.cumsum(np.maximum(often[: shortest + most].astype(np.float64) - usual, 0))
    choices = np.arange(min(LEAST_SHARED, most), most + 1)
    lengths = shortest + choices
    cost = lengths + CANDIDATE_COST * excess[lengths - 1] / choices
    shared = int(choices[cost.argmin()])
    end = shortest + shared
    return tokens[:end].copy(), often[:end].copy(), shared  # not views, which would keep the whole set


def within_reach(tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which postings, sorted by token, can be among the first l shared tokens with any other of their list.

    The smaller the other set, the later the place may be: the least size of the list that still fits decides.
    """
    if not len(tokens):
        return np.zeros(0, bool)
    begins = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    length = np.diff(np.concatenate((begins, [len(tokens)])))
    n, least = (sizes >> 3).astype(np.int64), (sizes & 7).astype(np.int64)
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    other = np.maximum(np.repeat(np.minimum.reduceat(n, begins), length), -(-n * p // q))
    overlap = -(-(n + other) * p // (p + q))
    return np.repeat(length > 1, length) & (places.astype(np.int64) <= n - overlap + least - 1)


def postings(rows: DataFrame, sketch: np.ndarray, seed: int) -> DataFrame:
    """(token, node, n, l, place, hot) of every prefix token that two nodes or more may hold. Those of hot tokens may repeat."""
    spark = rows.sparkSession
    width = shuffle_width(spark)
    buckets = 8 * width
    usual = float(np.median(sketch))
    shared = spark.sparkContext.broadcast(sketch)
    hot = max(HOT, int(8 * usual))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # copies within a task are posted once
        held, size = [], 0

        def flush():
            lengths = [len(h[0]) for h in held]
            tokens, often = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            nodes, sizes = (np.repeat(np.array([h[i] for h in held], np.int64), lengths) for i in (2, 3))
            places = np.concatenate([np.arange(x, dtype=np.uint32) for x in lengths])
            spread = (tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            of_hot, of_rest = (spread % np.uint64(m) for m in (width, buckets))
            bucket = np.where(often >= hot, -1 - of_hot.astype(np.int64), of_rest.astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
            cut = [*edge, len(order)]
            part = lambda x: [x[order[a:z]].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
            packed = {"tokens": tokens, "nodes": nodes, "sizes": sizes.astype(np.uint32), "places": places}
            return pd.DataFrame({"bucket": bucket[order][edge], **{k: part(v) for k, v in packed.items()}})

        for b in batches:
            for own in _sets(b["text"].tolist()):
                if not len(own):
                    continue
                node, _ = _signature(own, seed)
                if node in seen:
                    continue
                seen.add(node)
                tokens, often, least = prefix(own, shared.value, usual)
                held.append((tokens, often, node, len(own) << 3 | least))
                size += len(tokens)
                if size > PACKED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def unpack(frame: pd.DataFrame):
        kinds = {"tokens": np.uint64, "nodes": np.int64, "sizes": np.uint32, "places": np.uint32}
        return [np.concatenate([np.frombuffer(x, kind) for x in frame[name]]) for name, kind in kinds.items()]

    def rows_of(tokens, nodes, sizes, places, hot=False) -> pd.DataFrame:
        sizes = sizes.astype(np.int64)
        columns = {"token": tokens.view(np.int64), "node": nodes, "n": sizes >> 3, "l": sizes & 7, "place": places}
        return pd.DataFrame(columns).assign(hot=hot)

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_bucket: dict[int, list] = {}
        for b in batches:
            for bucket, own in b.groupby("bucket"):
                if bucket < 0:  # hot: known to be shared
                    yield rows_of(*unpack(own), hot=True)
                else:
                    by_bucket.setdefault(bucket, []).append(unpack(own))
        for parts in by_bucket.values():
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            columns = [x[order] for x in columns]
            again = np.concatenate(([False], columns[0][1:] == columns[0][:-1]))
            new = ~(again & np.concatenate(([False], columns[1][1:] == columns[1][:-1])))
            columns = [x[new] for x in columns]
            same = columns[0][1:] == columns[0][:-1]
            keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
            columns = [x[keep] for x in columns]
            for _ in range(2):  # a posting out of reach may leave others alone with their token
                columns = [x[within_reach(*columns)] for x in columns]
            yield rows_of(*columns)

    packed = rows.select("text").mapInPandas(pack, "bucket long, tokens binary, nodes binary, sizes binary, places binary")
    dealt = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.pmod(F.xxhash64("nodes", "bucket"), F.lit(buckets)))
    spread = packed.repartition(width, dealt)
    return spread.mapInPandas(several, "token long, node long, n int, l int, place int, hot boolean")


def fits(n: str, m: str) -> Column:
    """Whether two set sizes allow the similarity."""
    p, q = F.lit(SIMILARITY.numerator), F.lit(SIMILARITY.denominator)
    return F.least(n, m) * q >= F.greatest(n, m) * p


def among_first(n1: str, l1: str, place1: str, n2: str, l2: str, place2: str) -> Column:
    """Whether a token that two sets share can be one of the first l they share, if they are similar."""
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    overlap = F.expr(f"(({n1} + {n2}) * {p} + {p + q - 1}) div {p + q}")
    reach = F.least(l1, l2) - 1 - overlap
    return (F.col(place1) <= F.col(n1) + reach) & (F.col(place2) <= F.col(n2) + reach)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets are similar enough. ``texts`` from :func:`node_texts`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, q = SIMILARITY.numerator, SIMILARITY.denominator
        plain = zstandard.ZstdDecompressor()

        def sets(packed) -> list[np.ndarray]:
            return list(_sets([plain.decompress(x).decode("utf-8", "surrogatepass") for x in packed]))

        for whole in batches:
            for at in range(0, len(whole), 512):
                f = whole.iloc[at : at + 512]
                hubs = f.drop_duplicates("b")
                second = dict(zip(hubs["b"], sets(hubs["y"]), strict=True))
                keep = np.zeros(len(f), bool)
                for i, (u, b) in enumerate(zip(sets(f["x"]), f["b"], strict=True)):
                    both = np.concatenate((u, second[b]))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    keep[i] = q * shared >= p * (len(both) - shared)
                yield f[keep][["a", "b"]]

    first = texts.select(F.col("node").alias("a"), F.col("packed").alias("x"))
    second = texts.select(F.col("node").alias("b"), F.col("packed").alias("y"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").mapInPandas(run, "a long, b long")


def node_texts(rows: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed): one compressed text per node, a third of the size of its hashes."""
    one = known.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in b["text"]]
            yield pd.DataFrame({"node": b["node"].to_numpy(), "packed": packed})

    wanted = one.select("k.k1", "k.k2", "node")
    found = join_wanted(rows.select("k1", "k2", "text"), wanted).select("node", "text")
    return found.mapInPandas(run, "node long, packed binary").dropDuplicates(["node"])


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("comp", F.col("node"))
    return lists.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _with_links(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``labels`` (node, component) after new ``links`` (a, b), contracted to them first."""
    if labels is None:
        return cut_lineage(components(links), "labels")
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), "component")
        links = links.join(of, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    merged = cut_lineage(components(links.select("a", "b")), "merged")
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    moved = labels.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return cut_lineage(moved.unionByName(merged.join(labels, "node", "left_anti")), "labels")


def _mixed(lists: DataFrame) -> DataFrame:
    """Lists that hold more than one component, with ``top``, the one with most nodes in the list."""
    counts = lists.groupBy("token", "comp").agg(F.count("*").alias("c"))
    several = counts.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count("*").alias("k"))
    return lists.join(several.filter("k > 1").drop("k"), "token")


def leader_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """For each node of the lists its most frequent leader of another component: one per list and size."""
    sized = lists.withColumn("band", F.floor(F.log(4 / 3, F.col("n")) + F.lit(turn / 4)))
    may_lead = sized.filter("comp <> top") if turn else sized
    leaders = may_lead.groupBy("token", "band").agg(
        F.max_by(
            F.struct("node", "comp", "n", "l", "place"), F.struct("weight", F.xxhash64(F.lit(turn), "comp", "node"))
        ).alias("lead")
    )
    met = sized.join(leaders, ["token", "band"]).filter(
        (F.col("comp") != F.col("lead.comp"))
        & fits("n", "lead.n")
        & among_first("n", "l", "place", "lead.n", "lead.l", "lead.place")
    )
    counts = met.groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).agg(
        F.count("*").alias("c"), F.min(F.least("l", "lead.l")).alias("enough")
    )
    return counts.filter("c >= enough").groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def rest_pairs(lists: DataFrame) -> DataFrame:
    """(a, b) of different components that share enough prefix tokens."""
    inside, others = lists.filter("comp = top"), lists.filter("comp <> top")
    columns = ("node", "n", "l", "comp", "place")
    left = others.select("token", *(F.col(c).alias(f"{c}1") for c in columns))
    both = inside.withColumn("inside", F.lit(True)).unionByName(others.withColumn("inside", F.lit(False)))
    right = both.select("token", "inside", *(F.col(c).alias(f"{c}2") for c in columns))
    once = F.col("inside") | (F.col("node1") < F.col("node2"))  # two others meet twice
    met = left.join(right, "token").filter(
        once
        & (F.col("comp1") != F.col("comp2"))
        & fits("n1", "n2")
        & among_first("n1", "l1", "place1", "n2", "l2", "place2")
    )
    pairs = met.select(
        F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"), F.least("l1", "l2").alias("enough")
    )
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("enough").alias("enough"))
    return counts.filter("c >= enough").select("a", "b")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, n_shingles, component_id) per row of ``docs``.

    All steps with Python end in stored tables here, so small batches hold for them.
    """
    with small_batches(docs.sparkSession):
        return _components_of(docs)


def _components_of(docs: DataFrame) -> DataFrame:
    rows = text_rows(docs)
    seed = 0
    while True:
        signed = cut_lineage(signatures(rows, seed), "signatures")
        texts = signed.filter("piece < 0").select("k1", "k2", "node", "check", "n")
        clash = texts.groupBy("node").agg(F.min("check").alias("u"), F.max("check").alias("v")).filter("u <> v")
        if clash.isEmpty():
            break
        seed += 1  # two sets with one 64-bit name: take other names
    sketch = frequencies(signed.filter("piece >= 0").select("piece", "counts"))
    posted = cut_lineage(postings(rows, sketch, seed), "postings")
    lists = posted.filter("NOT hot").unionAll(posted.filter("hot").distinct()).drop("hot")
    known = texts.filter("n > 0").select("k1", "k2", "node")
    labels: DataFrame | None = None

    def linked(found: DataFrame) -> DataFrame:
        pairs = cut_lineage(found, "pairs")
        ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        texts_of = cut_lineage(node_texts(rows, known, ends), "node-texts")
        new = cut_lineage(verified(pairs, texts_of), "links")
        forget(pairs)
        forget(texts_of)
        return new

    long = lists.groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") >= LONG)
    long_lists = lists.join(long, "token")
    weights = long_lists.groupBy("node").agg(F.sum("c").alias("weight"))
    long_lists = cut_lineage(long_lists.drop("c").join(weights, "node"), "long-lists")
    n_links = 0
    for turn in range(ROUNDS):
        mixed = cut_lineage(_mixed(_labelled(long_lists, labels)), "mixed")
        new = linked(leader_pairs(mixed, turn))
        forget(mixed)
        n_new = new.count()
        if n_new:
            labels = _with_links(labels, new)
        n_links += n_new
        if n_new <= WORTH * n_links:
            break
    forget(long_lists)
    mixed = cut_lineage(_mixed(_labelled(lists, labels)), "mixed")
    joined = _with_links(labels, linked(rest_pairs(mixed)))
    forget(mixed)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    named = (
        rows.select("k1", "k2", "doc_id")
        .join(texts.dropDuplicates(["k1", "k2"]), ["k1", "k2"])
        .join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    first = named.filter("n > 0").groupBy("component").agg(F.min(order).alias("first"))
    return named.join(first, "component", "left").select(
        "k1",
        "k2",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("component")).alias("component"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id, and all without words."""
    found = jaccard_components(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    first = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("o"))
    one = first.select("o.k1", "o.k2")
    empty = found.filter(F.col("component").isNull()).select("k1", "k2").distinct()
    rows = keyed_rows(docs)
    kept = rows.join(one, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return kept.select("row").unionAll(rows.join(empty, ["k1", "k2"], "left_semi").select("row")).select("row.*")


#: Brute force: all pairs that share a shingle, then the closure of their links.
SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:least(i + 4, len(w))], ' ')) AS s
  FROM words, LATERAL unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i)
  WHERE array_to_string(w, '') <> ''),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""
