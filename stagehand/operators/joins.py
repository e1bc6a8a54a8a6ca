"""Join helpers: broadcast only behind a checked size bound."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default bounds for a broadcast side, in rows and in (estimated) bytes. Beyond
# them the plan falls back to a shuffle join that AQE can still convert (from
# measured map output) or split when skewed.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

_ROW_OVERHEAD = 16


def _fixed_width(dt: T.DataType) -> int | None:
    if isinstance(dt, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(dt, (T.ShortType,)):
        return 2
    if isinstance(dt, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    if isinstance(dt, (T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType)):
        return 8
    if isinstance(dt, T.DecimalType):
        return 16
    return None                                   # strings, binary, nested: measured


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast iff ``df`` provably has at most ``max_rows`` rows and
    about ``max_bytes`` bytes.

    The check is one job over ``limit(max_rows + 1)``, which stops reading as
    soon as the row bound is exceeded, so it is cheap on a big table and exact on
    a small one. It counts the rows and measures variable-width columns (text
    length; nested values by their JSON length), so a narrow-looking side with
    long strings is not broadcast. Otherwise the frame is returned unhinted.
    """
    fixed, measured = 0, []
    for f in df.schema.fields:
        w = _fixed_width(f.dataType)
        if w is not None:
            fixed += w
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            measured.append(F.length(F.col(f"`{f.name}`")))
        else:
            measured.append(F.length(F.to_json(F.col(f"`{f.name}`"))))
    sizes = [F.coalesce(F.sum(m), F.lit(0)).cast("bigint") for m in measured]
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)), *sizes).first()
    n, var_bytes = row[0], sum(row[1:])
    est = n * (fixed + _ROW_OVERHEAD) + var_bytes
    return F.broadcast(df) if n <= max_rows and est <= max_bytes else df
