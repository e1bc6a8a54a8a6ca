"""Incremental staging: a table clustered into key ranges, of which a change rewrites only those it touches.

A table is a folder ``range=<id>`` per key range plus ``_ranges`` (id, low key,
parent: the range it was cut from). ``build`` cuts the ranges by Spark's range
partitioner. ``refresh`` takes the keys that a batch of raw rows touched and the
staged rows these keys have now; it looks up their ranges, merges the ranges'
other rows with the new ones and overwrites just these folders, so all other
files keep their names. A range that has grown to twice its size is cut again,
and one that lost its last row is removed.

A range holds whole keys; a key with very many rows makes its range large, but
its rows are written by several tasks (ranges are dealt by key and row hash). The
ranges themselves are about rows / ``rows_per_range`` in number; only their low
keys are held by the driver and the tasks that look ranges up.

New bounds are written before the folders. A run that dies in between is
repeated with the same changes: a range's rows are also looked for in the range
that it was cut from.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

RANGE = "range"
Bounds = list[tuple[int, str | None, int]]          # id, low key (None: from the start), parent


def _read_bounds(spark: SparkSession, path: str) -> Bounds:
    rows = spark.read.parquet(f"{path}/_ranges").collect()   # one row per range
    return sorted(((r.id, r.low, r.parent) for r in rows), key=lambda b: (b[1] is not None, b[1] or ""))


def _write_bounds(spark: SparkSession, path: str, bounds: Bounds) -> None:
    spark.createDataFrame(bounds, "id int, low string, parent int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_ranges")


def with_range(df: DataFrame, key: str, bounds: Bounds) -> DataFrame:
    """``df`` with the id of each row's range; a null key is in the first one."""
    lows = np.array([b[1] for b in bounds[1:]], dtype=object)
    ids = np.array([b[0] for b in bounds], dtype=np.int32)
    schema = f"{df.select(key).schema[0].simpleString().replace(':', ' ')}, {RANGE} int"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array([k if k is not None else "" for k in b.column(0).to_pylist()], dtype=object)
            at = np.searchsorted(lows, keys, side="right") if len(lows) else np.zeros(len(keys), dtype=np.int64)
            yield pa.record_batch([b.column(0), pa.array(ids[at], pa.int32())], names=[key, RANGE])

    if len(bounds) == 1:
        return df.withColumn(RANGE, F.lit(bounds[0][0]))
    found = df.select(key).distinct().mapInArrow(look_up, schema)
    same = df[key].eqNullSafe(found[key])
    return df.join(found, same, "left").select(*[df[c] for c in df.columns], found[RANGE])


def _cut(df: DataFrame, key: str, n: int) -> DataFrame:
    """Low keys of ``n`` ranges of about equal size (column ``low``), without the first range's."""
    parts = materialize(df.select(key).repartitionByRange(n, key).select(key, F.spark_partition_id().alias("_p")), "cut")
    lows = parts.groupBy("_p").agg(F.min(key).alias("low")).where("low IS NOT NULL").orderBy("low")
    return lows.select("low")


def _write(df: DataFrame, key: str, path: str, n: int) -> None:
    """Overwrite the folders of the ranges that ``df`` has rows of; rows ordered by key in every file."""
    columns = [c for c in df.columns if c != RANGE]
    spread = F.xxhash64(*columns)
    (df.repartitionByRange(max(n, 1), RANGE, key, spread).sortWithinPartitions(RANGE, key)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(path))


def build(df: DataFrame, key: str, path: str, rows_per_range: int = 4_000_000) -> None:
    """Create or replace the table at ``path`` from all its rows. ``key``: a string column."""
    spark = df.sparkSession
    rows = materialize(df, "staged")
    n = max(1, math.ceil(rows.count() / rows_per_range))
    lows = [r.low for r in _cut(rows, key, n).collect()][1:] if n > 1 else []
    bounds: Bounds = [(k, low, k) for k, low in enumerate([None, *lows])]
    _delete(spark, path)
    _write_bounds(spark, path, bounds)
    _write(with_range(rows, key, bounds), key, path, n)


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of the table (min/max of its files and its folders prune on the key)."""
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path).drop(RANGE)


def touched_ranges(spark: SparkSession, path: str, changed: DataFrame, key: str) -> list[int]:
    """Ids of the ranges that hold ``changed`` keys, and of those that these were cut from."""
    bounds = _read_bounds(spark, path)
    parent = {b[0]: b[2] for b in bounds}
    found = {r[0] for r in with_range(changed.select(key).distinct(), key, bounds).select(RANGE).distinct().collect()}
    return sorted(found | {parent[i] for i in found})


def rows_of(spark: SparkSession, path: str, changed: DataFrame, key: str) -> DataFrame:
    """The table's present rows of the ``changed`` keys; reads only the ranges these are in."""
    ids = touched_ranges(spark, path, changed, key)
    table = spark.read.parquet(path).where(F.col(RANGE).isin(ids)).drop(RANGE)
    return table.join(changed.select(key).distinct(), key, "left_semi")


def refresh(path: str, key: str, changed: DataFrame, fresh: DataFrame, rows_per_range: int = 4_000_000) -> list[int]:
    """Give the ``changed`` keys the rows ``fresh`` (all that they have now; none removes
    a key) and rewrite the ranges that they are in. Returns the ids of the ranges written."""
    spark = fresh.sparkSession
    changed = materialize(changed.select(key).distinct(), "changed-keys")
    ids = touched_ranges(spark, path, changed, key)
    if not ids:
        return []
    bounds = _read_bounds(spark, path)
    table = spark.read.parquet(path)
    others = table.where(F.col(RANGE).isin(ids)).drop(RANGE).join(changed, key, "left_anti")
    mine = fresh.join(changed, key, "left_semi").select(*others.columns)
    # written first: the folders it comes from are overwritten
    merged = materialize(with_range(others.unionByName(mine), key, bounds), "merged")
    sizes = {r[RANGE]: r["count"] for r in merged.groupBy(RANGE).count().collect()}   # one row per touched range
    large = [i for i, n in sizes.items() if n > 2 * rows_per_range]
    if large:
        bounds = _split(merged, key, bounds, {i: sizes[i] for i in large}, rows_per_range)
        _write_bounds(spark, path, bounds)
        merged = materialize(with_range(merged.drop(RANGE), key, bounds), "merged")
    present = {r[RANGE] for r in merged.select(RANGE).distinct().collect()}
    _write(merged, key, path, math.ceil(sum(sizes.values()) / rows_per_range))
    for i in ids:
        if i not in present:
            _delete(spark, f"{path}/{RANGE}={i}")
    return sorted({*ids, *present})


def _split(merged: DataFrame, key: str, bounds: Bounds, large: dict[int, int], rows_per_range: int) -> Bounds:
    """The bounds with the large ranges cut into ranges of about ``rows_per_range`` rows."""
    n = sum(math.ceil(v / rows_per_range) for v in large.values())
    lows = [r.low for r in _cut(merged.where(F.col(RANGE).isin(list(large))), key, n).collect()]
    known = {b[1] for b in bounds}
    out, next_id = list(bounds), max(b[0] for b in bounds) + 1
    order = [b[1] or "" for b in bounds]
    for low in lows:
        at = int(np.searchsorted(np.array(order, dtype=object), low, side="right")) - 1
        if low not in known and bounds[at][0] in large:
            out.append((next_id, low, bounds[at][0]))
            next_id += 1
    return sorted(out, key=lambda b: (b[1] is not None, b[1] or ""))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
