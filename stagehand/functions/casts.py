"""Guarded safe casts and the raw-layer null rules, as native Column expressions.

Spark's ``try_cast`` is looser than a warehouse SAFE_CAST: it reads '2017-12' as a
date, '1.0f' as a double and '2016-05-31 22:30' as a date. Each cast below first
checks the canonical text shape with a regex and only then casts, so a value is
typed only when the source format is the documented one. Everything stays inside
whole-stage codegen; no Python runs per row.

Rules (raw layer):
  * blank means NULL or '' (CSV blanks arrive as NULL, XML blanks as '').
  * a missing rating is NULL ("not rated"), never 0; the token 'N/A' is a blank rating.
  * 'Not Ranked' is NULL rank.
  * a flag is three-valued: int('1') → true, any other int → false, blank/garbage → NULL.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text shapes.
INT_RE = r"^[+-]?[0-9]+$"
HEX_RE = r"^[+-]?0[xX][0-9a-fA-F]+$"
FLOAT_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INF_RE = r"(?i)^[+-]?inf(inity)?$"
NAN_RE = r"(?i)^[+-]?nan$"
DATE_RE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
DATETIME_RE = (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
               r"([ T][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(\.[0-9]{1,6})?)?$")
NOT_RANKED = "Not Ranked"
NO_RATING = "N/A"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def blank(col) -> Column:
    """NULL or empty string (P10)."""
    c = _c(col)
    return c.isNull() | (c == F.lit(""))


def nonblank(col) -> Column:
    """``col != ''`` with SQL semantics: NULL is not non-blank either."""
    return _c(col) != F.lit("")


def nullif(col, token: str) -> Column:
    """NULLIF(col, token)."""
    return F.nullif(_c(col), F.lit(token))


def safe_int(col) -> Column:
    """SAFE_CAST(x AS INT64) (F1): decimal or 0x-hex integer text, surrounding spaces
    allowed; a value beyond 64 bits is NULL."""
    s = F.trim(_c(col))
    digits = F.regexp_extract(s, r"^[+-]?0[xX]0*([0-9a-fA-F]*)$", 1)
    # ``conv`` saturates beyond 16 digits, so longer ones never reach it
    plain = F.when(digits == "", F.lit("0")).when(F.length(digits) <= 16, F.conv(digits, 16, 10))
    signed = F.when(s.startswith("-"), F.concat(F.lit("-"), plain)).otherwise(plain)
    return (F.when(s.rlike(INT_RE), s.try_cast("bigint"))
             .when(s.rlike(HEX_RE), signed.try_cast("bigint")))


def safe_double(col) -> Column:
    """SAFE_CAST(x AS FLOAT64) (F2): decimal/exponent text, or inf/infinity/nan words with an optional sign."""
    s = F.trim(_c(col))
    return (F.when(s.rlike(FLOAT_RE), s.try_cast("double"))
             .when(s.rlike(INF_RE), F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
             .when(s.rlike(NAN_RE), F.lit(float("nan"))))


def safe_date(col) -> Column:
    """SAFE_CAST(x AS DATE) (F3): only 'YYYY-M-D'; impossible days are NULL."""
    s = F.trim(_c(col))
    return F.when(s.rlike(DATE_RE), s.try_cast("date"))


def safe_datetime(col) -> Column:
    """SAFE_CAST(x AS DATETIME) (F4): 'YYYY-M-D[( |T)H:M:S[.ffffff]]', no zone."""
    s = F.trim(_c(col))
    return F.when(s.rlike(DATETIME_RE), s.try_cast("timestamp_ntz"))


def safe_rank(col) -> Column:
    """IF(rank = 'Not Ranked', NULL, rank) then int (F6 + F1)."""
    c = _c(col)
    return safe_int(F.when(c == F.lit(NOT_RANKED), F.lit(None)).otherwise(c))


def safe_rating(col) -> Column:
    """NULLIF(rating, 'N/A') then float: missing stays NULL, never 0."""
    return safe_double(nullif(col, NO_RATING))


def flag(col) -> Column:
    """String flag → three-valued boolean (F8): SAFE_CAST(NULLIF(x,'') AS INT64) = 1."""
    return safe_int(nullif(col, "")) == F.lit(1)


def int_nonblank(col) -> Column:
    """SAFE_CAST(NULLIF(x,'') AS INT64)."""
    return safe_int(nullif(col, ""))


def truncate(col, n: int = 200) -> Column:
    """First n characters of an error text."""
    return F.substring(_c(col), 1, n)


def rate(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """ROUND(num / den, digits) with a NULL (not an error) on an empty denominator."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), digits)


KIND_CASTS = {
    "str": lambda c: _c(c),
    "int": safe_int,
    "int_nb": int_nonblank,
    "double": safe_double,
    "date": safe_date,
    "datetime": safe_datetime,
    "flag": flag,
    "rank": safe_rank,
    "rating": safe_rating,
}


def cast_kind(col, kind: str) -> Column:
    try:
        return KIND_CASTS[kind](col)
    except KeyError:
        raise ValueError(f"unknown cast kind {kind!r}; known: {sorted(KIND_CASTS)}") from None
