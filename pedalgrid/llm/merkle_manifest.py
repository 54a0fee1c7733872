"""Merkle manifest: one leaf per row, one tree per language, one tree over the languages' roots.

A leaf is the SHA-256 of a row's fields. In each language the leaves stand in order of id; runs of
``fanout`` consecutive nodes become one node until one is left, the subroot; the subroots, in order of the
language, become the root in the same way. A row's proof holds the siblings on its way up.

Lag/lead windows build the trees. Rows are range-partitioned by (tree, order) for their places, so a
language that holds most rows is spread, and then lie in blocks of ``fanout ** depth`` consecutive nodes.
In a block every node is carried by the row of its first leaf: at level j its siblings are at the fixed row
offsets ``i * fanout ** j`` before (lag) and after it (lead), masked by its slot and by the length of
its run, and the row of a first child hashes the parent. All levels of a block share one shuffle and
one sort. The blocks' tops are the nodes of the next round: a few rounds for any number of rows. Going back
down, paths of blocks are joined to the rows below them.

Defined results: a null field counts as ``-``; null languages are a tree of their own, before all others; a
null id comes after all other ids of its tree; rows that repeat an id are leaves of their own, in the order of their
hashes. A tree of one leaf has that leaf as its root. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.session import cut_lineage, shuffle_width

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, DEPTH = 2, 8


def leaf_hash(*fields: Column) -> Column:
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def tree_name(value: Column) -> Column:
    """A name that sorts like ``value``, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def placed(nodes: DataFrame, *order: Column | str) -> DataFrame:
    """``nodes`` (tree, h, ...) with ``pos`` (from 0 in each tree) and ``size`` (nodes in the tree).

    Places are row numbers within value ranges and one offset per (tree, range); no tree is gathered.
    """
    ranged = nodes.repartitionByRange(shuffle_width(nodes.sparkSession), "tree", *order)
    sorted_rows = ranged.sortWithinPartitions("tree", *order)
    stored = cut_lineage(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "tree-nodes")
    stored = stored.withColumn("_range", F.shiftright("_at", 33))
    runs = stored.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = W.partitionBy("tree")
    before = tree.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.select(
        "tree",
        "_range",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(tree).alias("size"),
    )
    return (
        stored.join(starts, ["tree", "_range"])
        .withColumn("pos", F.col("_at") + F.col("_shift"))
        .drop("_at", "_range", "_shift")
    )


def climbed(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``depth`` levels up: ``steps`` (left and right siblings per level), ``block``, and ``top``, the
    block's node above, with ``head`` on one row of each block."""
    pos, size = F.col("pos"), F.col("size")
    rows = nodes.withColumn("block", F.floor(pos / fanout**depth)).withColumn("_h0", F.col("h"))
    block = W.partitionBy("tree", "block")
    ordered = block.orderBy("pos")
    for level in range(depth):
        step, h = fanout**level, F.col(f"_h{level}")
        there = F.ceil(size / step)  # nodes of the tree at this level
        place = F.floor(pos / step)
        slot = place % fanout
        run = F.least(F.lit(fanout), there - place + slot)
        left = [F.when(slot >= i, F.lag(h, i * step).over(ordered)) for i in range(fanout - 1, 0, -1)]
        right = [F.when(slot + i < run, F.lead(h, i * step).over(ordered)) for i in range(1, fanout)]
        first_child = pos % (step * fanout) == 0
        rows = rows.withColumns({f"_l{level}": F.concat_ws("", *left), f"_r{level}": F.concat_ws("", *right)})
        parent = F.when(there > 1, F.sha2(F.concat(h, F.col(f"_r{level}")), 256)).otherwise(h)
        own = F.struct(F.col(f"_l{level}").alias("left"), F.col(f"_r{level}").alias("right"))
        rows = rows.withColumns(
            {
                f"_h{level + 1}": F.when(first_child, parent),
                f"_s{level}": F.when((there > 1) & h.isNotNull(), own),
            }
        )
    # A node's siblings lie on the row of its first leaf, the last such row up to each of its leaves.
    so_far = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    paths = [F.last(f"_s{level}", ignorenulls=True).over(so_far).alias(f"_p{level}") for level in range(depth)]
    kept = [*nodes.columns, "block"]
    rows = rows.select(*kept, *paths, F.first(f"_h{depth}").over(ordered).alias("top"))
    steps = F.array_compact(F.array(*(f"_p{level}" for level in range(depth))))
    return rows.select(*kept, "top", (pos % fanout**depth == 0).alias("head"), steps.alias("steps"))


def rounds(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """The stored blocks from the leaves up to those that are whole trees."""
    found = [cut_lineage(climbed(nodes, fanout, depth), "tree-blocks")]
    width = fanout**depth
    while (found[-1].agg(F.max("size")).first()[0] or 0) > width:
        above = found[-1].filter("head").select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("size") / width).alias("size"), F.col("top").alias("h")
        )
        found.append(cut_lineage(climbed(above, fanout, depth), "tree-blocks"))
    return found


def _down(blocks: list[DataFrame], highest: DataFrame, *carried: str) -> DataFrame:
    """Rows of the lowest blocks with whole paths; ``highest`` is the last of ``blocks`` with the columns
    ``carried`` that all rows below inherit."""
    rows = highest
    for below in reversed(blocks[:-1]):
        above = rows.select(
            F.col("tree"), F.col("pos").alias("block"), F.col("steps").alias("_above"), *carried
        )
        rows = below.join(above, ["tree", "block"]).withColumn("steps", F.concat("steps", "_above")).drop("_above")
    return rows


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def merkle_manifest(leaves: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``leaves`` (tree from :func:`tree_name`, doc_id, h, any others) with subroot, root and ``steps``,
    the (left, right) siblings per level from the leaf to the root."""
    stored = cut_lineage(leaves, "leaves")
    blocks = rounds(placed(stored, F.col("doc_id").asc_nulls_last(), F.col("h")), fanout, depth)
    whole = blocks[-1]
    subroots = whole.filter("pos = 0").select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("h")
    )
    upper = rounds(placed(subroots, "name"), fanout, depth)
    roots = _down(upper, upper[-1].withColumn("root", F.col("top")), "root")
    roots = cut_lineage(roots.select(F.col("name").alias("tree"), F.col("steps").alias("_last"), "root"), "roots")
    highest = whole.join(roots, "tree").withColumns(
        {"steps": F.concat("steps", "_last"), "subroot": F.col("top")}
    )
    return _down(blocks, highest, "subroot", "root").select(*leaves.columns, "subroot", "root", "steps")


def document_manifest(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, steps) per row of ``docs``."""
    leaves = docs.select(
        tree_name(F.col("lang")).alias("tree"), "doc_id", "lang", leaf_hash(*map(F.col, FIELDS)).alias("h")
    )
    return merkle_manifest(leaves, fanout).withColumnRenamed("h", "leaf").drop("tree")


def tampered(docs: DataFrame) -> Column:
    """What ``n_chars`` becomes: one more where 7 divides the CRC-32 of the decimal id."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.col("n_chars") + 1).otherwise(F.col("n_chars"))


def manifest_digests(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, checked against rows of which some are tampered with."""
    changed = [tampered(docs) if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select(
        tree_name(F.col("lang")).alias("tree"),
        "doc_id",
        leaf_hash(*map(F.col, FIELDS)).alias("h"),
        leaf_hash(*changed).alias("seen"),
    )
    whole = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    found = merkle_manifest(leaves).select(
        "doc_id",
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        F.sha2(whole, 256).alias("proof_sha256"),
        folded(F.col("seen"), F.col("steps")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB has no CRC-32: its table of 256 numbers comes from the polynomial, text from its bytes.
CRC32_TABLE = """crc_steps(b, i, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT b, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_steps WHERE i < 8),
crc_table AS (SELECT list(c ORDER BY b) AS tab FROM crc_steps WHERE i = 8)"""


def crc32_sql(text: str) -> str:
    """The CRC-32 of a VARCHAR expression; ``tab`` must be in scope, from ``crc_table``."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(len({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    fold = f"list_reduce(list_prepend(4294967295, {octets}), lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1]))"
    return f"xor({fold}, 4294967295)"


SQL = f"""
WITH RECURSIVE {CRC32_TABLE},
seen AS (
  SELECT row_number() OVER () AS id, *,
    n_chars + CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 7 = 0 THEN 1 ELSE 0 END AS n_seen
  FROM documents, crc_table),
fields AS (
  SELECT id, doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS b,
    coalesce(strlen(n_seen::VARCHAR) || ':' || n_seen, '-') AS b_seen,
    coalesce(strlen(text) || ':' || text, '-') AS c
  FROM seen),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS m
  FROM (SELECT id, doc_id, lang, sha256(a || b || c) AS leaf, sha256(a || b_seen || c) AS leaf_seen FROM fields)),
low AS (
  SELECT lang, 0 AS level, pos, leaf AS h, m FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((m + 1) // 2)
  FROM low WHERE m > 1 GROUP BY lang, level, pos // 2),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS m
  FROM low WHERE m = 1),
high AS (
  SELECT 0 AS level, pos, subroot AS h, m FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((m + 1) // 2)
  FROM high WHERE m > 1 GROUP BY level, pos // 2),
path AS (
  SELECT l.id, own.level AS k, own.pos % 2 AS slot, coalesce(sib.h, '') AS h
  FROM leaves l
  JOIN low own ON own.lang IS NOT DISTINCT FROM l.lang AND own.pos = l.pos >> own.level AND own.m > 1
  LEFT JOIN low sib
    ON sib.lang IS NOT DISTINCT FROM own.lang AND sib.level = own.level AND sib.pos = xor(own.pos, 1)
  UNION ALL
  SELECT l.id, 1000 + own.level, own.pos % 2, coalesce(sib.h, '')
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
  JOIN high own ON own.pos = s.pos >> own.level AND own.m > 1
  LEFT JOIN high sib ON sib.level = own.level AND sib.pos = xor(own.pos, 1)),
steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS i FROM path),
fold AS (
  SELECT id, 0 AS i, leaf_seen AS h FROM leaves
  UNION ALL
  SELECT fold.id, steps.i, sha256(CASE WHEN slot = 1 THEN steps.h || fold.h ELSE fold.h || steps.h END)
  FROM fold JOIN steps ON steps.id = fold.id AND steps.i = fold.i + 1),
proofs AS (SELECT id, string_agg(h, '' ORDER BY i) AS proof FROM steps GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, last.h AS folded_root,
  last.h = root AS verified
FROM leaves
JOIN subroots ON subroots.lang IS NOT DISTINCT FROM leaves.lang
CROSS JOIN (SELECT h AS root FROM high WHERE m = 1)
LEFT JOIN proofs USING (id)
JOIN (SELECT id, arg_max(h, i) AS h FROM fold GROUP BY id) last USING (id)
"""
