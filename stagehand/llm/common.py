"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound_batches(spark, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows in this session. Spark's default of
    10,000 is meant for narrow rows; of whole texts it makes batches of tens of MB,
    held in the JVM's direct memory and again in every Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables, for operators on its texts."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text) under fixed internal names, so other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))


def slices(batches: Iterator[pa.RecordBatch], max_rows: int, text: str = "_text",
           max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``max_rows`` rows and about
    ``max_bytes`` of text (one row may be longer): bounds a Python worker's memory."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, s in enumerate(sizes):
            if i > start and (i - start >= max_rows or size + s > max_bytes):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(s)
        if start < batch.num_rows:
            yield batch.slice(start)
