"""First or last row per key by hash aggregation.

``min_by`` over structs or strings is a sort aggregate in Spark: its buffer has no
fixed width, so every task sorts its rows. Here the order columns are packed into
one decimal, whose order is theirs (NULL least), and then

* kept columns of fixed width are picked by ``min_by`` of that decimal: one hash
  aggregate, no join;
* strings and other wide columns cannot stand in such a buffer: the extreme order
  per key is found by a hash aggregate, and the rows that hold it are joined back on
  (key, order). The join's key spreads a hot key's rows; only winners meet. It reads
  the input twice, so callers ask for it (``reread``) where that is a stored table.

Ties: one of the tied rows; with a join back the one with the least (greatest) hash
of its kept columns, the same one each time. Order columns that do not pack
(strings, doubles, more than 126 bits together) keep the sort aggregate: it sorts
inside a task, which costs less than any way that would move all rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the values of the types that pack; one bit more tells NULL from the least value.
_BITS = {T.BooleanType: 1, T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.DateType: 32,
         T.LongType: 64, T.TimestampType: 60}
_MAX_MICROS = 253402300800 * 10**6   # Spark's timestamps end with the year 9999; its year 1 is nearer to 1970
_FIXED = (*_BITS, T.FloatType, T.DoubleType, T.TimestampNTZType, T.DecimalType)
_MAX_BITS = 126   # 2^126 < 10^38
_TIE_BITS = 40    # least room for the hash that orders ties


def _digit(df: DataFrame, name: str) -> tuple[Column, int]:
    """The value as a number from 0 (NULL) to 2^bits, and its bits."""
    kind, c = type(df.schema[name].dataType), F.col(f"`{name}`")
    if kind is T.DateType:
        c = F.unix_date(c)
    elif kind is T.TimestampType:
        c = F.when(c.isNotNull(), F.greatest(F.least(F.unix_micros(c), F.lit(_MAX_MICROS)), F.lit(-_MAX_MICROS)))
    elif kind is T.BooleanType:
        c = c.cast("int")
    low = 0 if kind is T.BooleanType else 1 << (_BITS[kind] - 1)
    return F.coalesce(c.cast("decimal(38,0)") + F.expr(f"{low + 1}BD"), F.expr("0BD")), _BITS[kind] + 1


def packed_order(df: DataFrame, order_cols: Sequence[str], tie_cols: Sequence[str] = ()) -> Column | None:
    """One decimal in the order of ``order_cols``; None where they do not pack. With
    ``tie_cols`` its last bits are a hash of these, so that different rows differ."""
    if any(type(df.schema[c].dataType) not in _BITS for c in order_cols):
        return None
    digits = [_digit(df, c) for c in order_cols]
    room = _MAX_BITS - sum(bits for _, bits in digits)
    if room < (_TIE_BITS if tie_cols else 0):
        return None
    if tie_cols:
        bits = min(room, 62)
        digits.append((F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in tie_cols]), F.lit(1 << bits)).cast("decimal(38,0)"), bits))
    out = digits[0][0]
    for digit, bits in digits[1:]:
        out = (out * F.expr(f"{1 << bits}BD") + digit).cast("decimal(38,0)")
    return out.cast("decimal(38,0)")


def extreme_row(df: DataFrame, key: str, order_cols: Sequence[str], keep: Sequence[str], last: bool = False,
                reread: bool = False) -> DataFrame:
    """One row (key, ``keep``) per key: the first by ``order_cols``, or the last."""
    pick, edge = (F.max_by, F.max) if last else (F.min_by, F.min)
    keep = [c for c in keep if c != key]
    kept = [F.col(f"`{c}`") for c in keep]
    if all(isinstance(df.schema[c].dataType, _FIXED) for c in keep):
        order = packed_order(df, order_cols)
        if order is not None:
            rows = df.select(F.col(f"`{key}`"), *kept, order.alias("_order"))
            # all columns are picked by the same comparisons, so they are of one row
            return rows.groupBy(key).agg(*[pick(F.col(f"`{c}`"), F.col("_order")).alias(c) for c in keep]).select(key, *keep)
    elif reread:
        order = packed_order(df, order_cols, tie_cols=keep)
        if order is not None:
            rows = df.select(F.col(f"`{key}`").alias("_key"), F.struct(*kept).alias("_row"), order.alias("_order"))
            best = rows.groupBy("_key").agg(edge("_order").alias("_best")).withColumnRenamed("_key", "_of")
            won = rows.join(best, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_order") == F.col("_best")))
            # repeated rows fall together; a set of more than one needs two rows of equal order and hash
            one = won.groupBy("_key", "_row").agg(F.count(F.lit(1))).groupBy("_key").agg(
                F.array_min(F.collect_set("_row")).alias("_row"))
            return one.select(F.col("_key").alias(key), *[F.col("_row").getField(c).alias(c) for c in keep])
    best = pick(F.struct(*kept), F.struct(*[F.col(f"`{c}`") for c in order_cols]))
    return df.groupBy(key).agg(best.alias("_r")).select(key, *[F.col("_r").getField(c).alias(c) for c in keep])
