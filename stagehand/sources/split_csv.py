"""Multi-line CSV read in parallel: a large quoted file in as many tasks as it has splits.

A line break may sit inside a quoted field, so Spark's own multi-line reader
gives a whole file to one task. Here files are read as lines, which split
anywhere, and a line break is inside quotes iff the number of quotes before it
in its file is odd. That parity is a prefix scan:

1. one pass counts, per split, its *odd* lines (those with an odd number of
   quotes) and a running sum over a file's splits (a table of one row per split)
   gives the odd lines before each split;
2. a second pass counts the odd lines inside each split as it streams by; with
   the sum of step 1 every line knows the odd lines ``k`` before it in its file;
3. a line with even ``k`` and even quotes is a whole record and goes straight to
   ``from_csv``. The others are fragments: of the record number ``k div 2`` of
   their file. Only fragments are shuffled, grouped and joined to a record.

So text that holds no multi-line field is never shuffled, and no task holds more
than a batch of lines and one multi-line record.

Records end in LF or CRLF; in a record that ends in CRLF, CRLF inside quotes is
read as LF, as Spark's reader does; else line breaks are kept. A file whose quotes do not pair up raises ``ValueError``. Quotes must follow RFC 4180
(a quote inside an unquoted field is not one); null and blank fields and ragged
rows are treated as by ``raw_csv.read_csv_strings``. Empty lines between records
are skipped.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import bounded_broadcast

_LINES = "file long, start long, at long, k long, odd boolean, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, start, odd, value): every line, the split it is in and whether its quotes are odd in number."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), (quotes % 2 == 1).alias("odd"), "value")


def _splits(lines: DataFrame) -> DataFrame:
    """Per split: the odd lines before it in its file. Raises if a file's quotes do not pair up."""
    per = lines.groupBy("path", "file", "start").agg(F.count_if("odd").alias("n"))
    per = per.persist()  # one row per split
    try:
        files = per.groupBy("path", "file").agg(F.sum("n").alias("n")).groupBy("file").agg(
            F.count(F.lit(1)).alias("paths"), F.max(F.when(F.col("n") % 2 == 1, F.col("path"))).alias("bad"))
        wrong = files.where("bad IS NOT NULL OR paths > 1").first()
        if wrong is not None:
            raise ValueError(f"{wrong.bad}: a quoted field is not closed" if wrong.bad else "two file names share a hash")
        before = F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")
        rows = per.select("file", "start", before.alias("before")).collect() if per.count() <= _LOCAL_SPLITS else None
        if rows is not None:
            return lines.sparkSession.createDataFrame(rows, "file long, start long, before long")
        return per.select("file", "start", before.alias("before"))
    finally:
        per.unpersist()


#: Up to so many splits their sums are taken to the driver, so the first pass is not run again.
_LOCAL_SPLITS = 100_000


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each split (``at``) and counts its odd lines so far (``k``)."""
    last, at0, k0 = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        file, start = (b.column(c).to_numpy() for c in (0, 1))
        odd = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(odd)
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (file[1:] != file[:-1]) | (start[1:] != start[:-1])
        fresh[0] = (file[0], start[0]) != last
        before = np.cumsum(odd) - odd
        head = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        k = np.where(head >= 0, before - before[head], before + k0)
        at = np.where(head >= 0, np.arange(n) - head, np.arange(n) + at0)
        last, at0, k0 = (file[-1], start[-1]), int(at[-1]) + 1, int(k[-1] + odd[-1])
        yield pa.record_batch([b.column(0), b.column(1), pa.array(at), pa.array(k), b.column(2), b.column(3)],
                              names=["file", "start", "at", "k", "odd", "value"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, header): every CSV record of the files as one string, and whether it is the first of its file."""
    lines = _lines(spark, path)
    splits = bounded_broadcast(_splits(lines))
    numbered = (lines.select("file", "start", "odd", "value").mapInArrow(_number, _LINES).join(splits, ["file", "start"])
                .withColumn("k", F.col("k") + F.col("before")))
    inside = F.col("k") % 2 == 1
    header = (F.col("start") == 0) & (F.col("at") == 0)
    whole = numbered.where(~inside & ~F.col("odd")).select(F.col("value").alias("record"), header.alias("header"))
    parts = numbered.where(inside | F.col("odd")).groupBy("file", F.expr("k div 2").alias("number")).agg(
        F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("p"))
    joined = parts.select(F.array_join(F.col("p.value"), "\n").alias("record"),
                          ((F.col("p")[0]["start"] == 0) & (F.col("p")[0]["at"] == 0)).alias("header"))
    crlf = F.endswith("record", F.lit("\r"))
    text = F.when(crlf, F.expr("replace(left(record, length(record) - 1), '\r\n', '\n')")).otherwise(F.col("record"))
    return whole.unionByName(joined).select(text.alias("record"), "header")


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType | Sequence[str], ragged: str = "fail") -> DataFrame:
    """``raw_csv.read_csv_strings`` in parallel inside files: the same rows, every column a string."""
    names = [f.name for f in schema.fields] if isinstance(schema, T.StructType) else list(schema)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "mode": "FAILFAST" if ragged == "fail" else "PERMISSIVE"}
    header = spark.read.option("header", True).options(**options).csv(path).columns
    missing = [c for c in names if c not in header]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header {header}")
    found = ", ".join(f"`{c}` string" for c in header)
    rows = records(spark, path).where(F.col("record") != "")
    # a generator keeps the parse in one place: columns picked later do not narrow or repeat it
    parsed = rows.select("header", F.explode(F.array(F.from_csv("record", found, options))).alias("r"))
    first_cells = F.array(*[F.col("r").getField(c) for c in header])
    same = first_cells == F.array(*[F.lit(c) for c in header])
    checked = parsed.where(F.when(F.col("header"), F.when(same, F.lit(False)).otherwise(
        F.raise_error(F.concat(F.lit("another header: "), F.array_join(first_cells, ","))).cast("boolean"))).otherwise(F.lit(True)))
    return checked.select(*[F.col("r").getField(c).alias(c) for c in names])
