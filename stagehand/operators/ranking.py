"""Exact global order statistics without a global window.

A global rank needs every row's place in one total order. A window without a
partition puts the whole table in one task, and equal-width key ranges do not
help when keys cluster: one range may then hold a third of all rows. Here
Spark's own range partitioner cuts the keys. It samples them, places bounds so
every range holds about the same number of rows whatever the key
distribution, and assigns rows by binary search on the JVM, ranges in key
order. The range id is pinned by writing the keyed rows once to the shared
folder, so the pass that counts and the pass that numbers see the same cut.
Per-range sums (one row per range) give each range its offset, and rows are
ordered only inside their own range.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import bounded_broadcast

RANGE = "_r"


def ranged(df: DataFrame, key: str, rows_per_range: int = 1_000_000,
           min_ranges: int | None = None, n_rows: int | None = None) -> DataFrame:
    """``df`` with a column ``_r``: the id of its key range, ranges in key order.

    About ``rows_per_range`` rows per range (at least ``min_ranges``). The
    number of ranges follows the rows, not the cluster size, so a small input
    stays a few tasks and files, and the per-range table built from it stays
    about N / ``rows_per_range`` rows. ``n_rows`` (an estimate is enough) saves
    the counting pass.
    """
    n = df.count() if n_rows is None else n_rows
    ranges = max(min_ranges or 1, math.ceil(n / rows_per_range), 1)
    cut = df.repartitionByRange(ranges, F.col(key)).withColumn(RANGE, F.spark_partition_id())
    return materialize(cut, "ranged")


def cumulative(df: DataFrame, key: str, weight: Column | None = None,
               rows_per_range: int = 1_000_000, min_ranges: int | None = None,
               n_rows: int | None = None) -> DataFrame:
    """Each row with ``_before``: the total ``weight`` (default 1 per row) of all
    rows ordered before it by ``key`` (ties by key are broken arbitrarily but
    consistently only when keys are unique; callers pass unique keys)."""
    w = (weight if weight is not None else F.lit(1)).cast("bigint")
    r = ranged(df.withColumn("_w", w), key, rows_per_range, min_ranges, n_rows)
    per_range = r.groupBy(RANGE).agg(F.sum("_w").alias("_sum"))
    # one row per range (about N / rows_per_range): small enough to order in one
    # window; it still grows with N, so it is broadcast only behind a checked bound
    offsets = per_range.select(RANGE, F.coalesce(
        F.sum("_sum").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).cast("bigint").alias("_off"))
    inside = F.sum("_w").over(Window.partitionBy(RANGE).orderBy(key)
                              .rowsBetween(Window.unboundedPreceding, -1))
    return (r.join(bounded_broadcast(offsets), on=RANGE)
             .withColumn("_before", (F.col("_off") + F.coalesce(inside, F.lit(0))).cast("bigint"))
             .drop(RANGE, "_off"))


def global_index(df: DataFrame, key: str, rows_per_range: int = 1_000_000,
                 min_ranges: int | None = None) -> DataFrame:
    """0-based rank ``_idx`` of each row by a unique ``key``, exact, with no task
    seeing more than about ``rows_per_range`` rows whatever the key distribution."""
    return cumulative(df, key, None, rows_per_range, min_ranges).drop("_w").withColumnRenamed("_before", "_idx")


def exact_percentiles(df: DataFrame, value: str, ps: list[float], n_values: int | None = None,
                      rows_per_range: int = 1_000_000, min_ranges: int | None = None) -> list[float] | None:
    """Percentiles of ``value`` (NULLs ignored) exactly as Spark's ``percentile``
    aggregate gives them — linear interpolation between the order statistics at
    ``p·(N−1)`` — for any number of distinct values.

    Rows are first reduced to (distinct value, count) with a partial aggregate,
    so a value held by a third of all rows travels as one row per map task; the
    cumulative counts then locate the at most ``2·len(ps)`` values needed, and
    only those reach the driver. ``n_values`` (an estimate of the distinct
    values) sizes the ranges without a counting pass.
    """
    counts = (df.where(F.col(value).isNotNull())
                .groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    cum = cumulative(counts, "_v", F.col("_c"), rows_per_range, min_ranges, n_values)
    total = cum.agg(F.sum("_c")).first()[0]
    if not total:
        return None
    positions = [p * (total - 1) for p in ps]
    needed = sorted({i for pos in positions for i in (math.floor(pos), math.ceil(pos))})
    hit = F.lit(False)
    for i in needed:
        hit = hit | ((F.col("_before") <= F.lit(i)) & (F.lit(i) < F.col("_before") + F.col("_c")))
    found = cum.where(hit).select("_v", "_before", "_c").collect()        # ≤ len(needed) rows
    at = {i: r["_v"] for r in found for i in needed if r["_before"] <= i < r["_before"] + r["_c"]}
    out = []
    for pos in positions:
        lo, hi = math.floor(pos), math.ceil(pos)
        same = lo == hi or at[lo] == at[hi]
        out.append(at[lo] if same else (hi - pos) * at[lo] + (pos - lo) * at[hi])
    return out
