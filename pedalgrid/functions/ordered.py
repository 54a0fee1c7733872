"""Ordered computations that no single key can choke.

A window over one hot key runs in one task. Here an ordered key is cut into value
ranges of about equal row counts, the window runs inside (key, range), and what
crosses a range border is carried by a small per-range summary. The summary is spread by (key,
range) like the rows, so joining it back never gathers a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pedalgrid.session import cut_lineage, shuffle_width

MAX_SLICES = 2048


def slice_bounds(
    df: DataFrame, col: Column, slices: int | None = None, limit: int | None = MAX_SLICES
) -> list:
    """Ascending cut points that split ``col`` into ranges of about equal size.

    The driver gets at most ``limit`` numbers, whatever the size of ``df``; None leaves the
    number of ``slices`` to the caller.
    """
    n = slices or shuffle_width(df.sparkSession)
    n = n if limit is None else min(n, limit)
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(col, shares, 10 * n).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def slice_of(col: Column, bounds: Sequence) -> Column:
    """How many of ``bounds`` are <= ``col`` (all of them for NULL).

    A binary search over one constant array, in halving steps: the expression does not grow with the number of
    bounds, so it compiles for any width, and a row costs a comparison and a number per step. ``col`` is
    evaluated in every step.
    """
    if not bounds:
        return F.lit(0)
    cuts = F.array(*(F.lit(b) for b in bounds))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))

    def climb(at: Column, step: Column) -> Column:
        return F.when(F.get(cuts, at + step - 1) <= col, at + step).otherwise(at)

    return F.when(col.isNull(), F.lit(len(bounds))).otherwise(F.aggregate(steps, F.lit(0), climb))


def time_slices(df: DataFrame, time_col: str, slices: int | None = None) -> Column:
    us = F.unix_micros(F.col(time_col))
    return slice_of(us, slice_bounds(df, us, slices))


def _spread(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return summary.repartition(shuffle_width(summary.sparkSession), *keys, "_slice")


def sliced_row_number(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: Column,
    order: Sequence[Column],
    name: str = "rn",
    descending: bool = False,
) -> DataFrame:
    """``row_number()`` per key, from 1. ``slice_col`` must follow the first order column."""
    rows = df.withColumn("_slice", slice_col)
    by_slice = F.desc("_slice") if descending else F.asc("_slice")
    before = W.partitionBy(*keys).orderBy(by_slice).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(_spread(starts, keys), [*keys, "_slice"])
        .withColumn(name, F.col("_start") + F.col("_rn"))
        .drop("_slice", "_start", "_rn")
    )


def sliced_lag(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    cols: Sequence[str],
    name: str = "prev",
    slice_col: Column | None = None,
) -> DataFrame:
    """Add struct column ``prev`` with ``cols`` of the row before, NULL on a key's first row.

    ``(keys, time_col)`` must identify a row.
    """
    cut = time_slices(df, time_col) if slice_col is None else slice_col
    rows = df.withColumn("_slice", cut)
    state = F.struct(*cols)
    last = F.struct(*(F.col(f"_last_{c}").alias(c) for c in cols))
    inside = W.partitionBy(*keys, "_slice").orderBy(time_col)
    across = W.partitionBy(*keys).orderBy("_slice")
    carried = (
        rows.groupBy(*keys, "_slice")
        .agg(*(F.max_by(F.col(c), F.col(time_col)).alias(f"_last_{c}") for c in cols))
        .select(*keys, "_slice", F.lag(last).over(across).alias("_carried"))
    )
    return (
        rows.withColumn("_inside", F.lag(state).over(inside))
        .join(_spread(carried, keys), [*keys, "_slice"])
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_slice", "_inside", "_carried")
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Sequence[str],
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Running sums ``cum_<measure>`` over distinct values of ``value`` per key.

    ``df`` holds one row per (keys, value); it is read three times, so pass a stored table.
    """
    rows = df.withColumn("_slice", slice_of(F.col(value), slice_bounds(df, F.col(value), slices)))
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    before = W.partitionBy(*keys).orderBy(order("_slice")).rowsBetween(W.unboundedPreceding, -1)
    inside = (
        W.partitionBy(*keys, "_slice")
        .orderBy(order(value))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    starts = rows.groupBy(*keys, "_slice").agg(*(F.sum(m).alias(m) for m in measures))
    starts = starts.select(
        *keys,
        "_slice",
        *(F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_start_{m}") for m in measures),
    )
    out = rows.select("*", *(F.sum(m).over(inside).alias(f"_in_{m}") for m in measures))
    out = out.join(_spread(starts, keys), [*keys, "_slice"])
    return out.select(
        *df.columns, *((F.col(f"_start_{m}") + F.col(f"_in_{m}")).alias(f"cum_{m}") for m in measures)
    )


def value_ranks(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """``rank()`` of every distinct ``value`` over the whole table: (value, name)."""
    counts = cut_lineage(df.groupBy(value).agg(F.count("*").alias("n")), "rank")
    totals = running_totals(counts, [], value, ["n"], descending)
    return totals.select(value, (F.col("cum_n") - F.col("n") + 1).alias(name))


def global_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Number all rows from 0 in ``order``: range sort, then an offset per partition.

    Partition and place are stored with the rows, so they cannot change under a retry.
    """
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    where = cut_lineage(placed, "ordered").withColumns(
        {
            "_part": F.shiftrightunsigned("_at", 33),
            "_pos": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        where.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        where.join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_at", "_part", "_pos", "_start")
    )
