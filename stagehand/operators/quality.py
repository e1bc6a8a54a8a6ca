"""Data-quality checks as single-pass DataFrame jobs.

Every check takes DataFrames and column names and returns a small DataFrame.
Scale notes:
  * Key counts always aggregate *before* the shuffle (partial hash aggregate), so a
    key holding a third of all rows collapses to one row per map task and never
    lands whole in one reducer.
  * Anti joins run on per-key counts, not on fact rows: the shuffle carries one
    row per (map task, key) and the result is summed back to a row count.
  * Many metrics over one table are one ``agg`` (one scan, partial+final).
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import blank, cast_kind, nonblank, rate

def _one():
    return F.lit(1)


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# --- uniqueness -------------------------------------------------------------

def duplicate_keys(df: DataFrame, keys, count_col: str = "n") -> DataFrame:
    """Keys seen more than once, with their count (A1): GROUP BY k HAVING COUNT(*) > 1."""
    ks = _keys(keys)
    return (df.groupBy(*ks).agg(F.count(_one()).alias(count_col))
              .where(F.col(count_col) > 1))


def duplicate_key_count(df: DataFrame, keys, alias: str = "duplicate_pairs") -> DataFrame:
    """Number of duplicated keys (A2): an aggregate over the aggregate."""
    return duplicate_keys(df, keys).agg(F.count(_one()).alias(alias))


# --- referential integrity ---------------------------------------------------

def _key_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(_one()).alias(name))


def orphan_rows(fact: DataFrame, dim: DataFrame, key: str,
                alias: str = "orphan_rows", dim_key: str | None = None) -> DataFrame:
    """Fact rows whose key has no match in dim (J2, and J4 with a child table as dim).

    Same count as ``fact LEFT JOIN dim USING (key) WHERE dim.key IS NULL``: a NULL
    fact key never matches and counts as orphan. Both sides are reduced to
    distinct keys map-side, then anti-joined; the result is one row.
    """
    dk = dim_key or key
    per_key = _key_counts(fact, key, "_n")
    dim_keys = dim.select(F.col(dk).alias(key)).distinct()
    missing = per_key.join(dim_keys, on=key, how="left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias(alias))


def key_difference(a: DataFrame, b: DataFrame, key: str,
                   a_not_b: str = "in_a_not_b", b_not_a: str = "in_b_not_a") -> DataFrame:
    """Both directions of a key difference in one row and one pass.

    Row counts on each side whose key is absent from the other side, computed
    with a single full outer join of per-key counts (no cross join of scalars).
    """
    ak = _key_counts(a, key, "_na")
    bk = _key_counts(b, key, "_nb")
    # a NULL key never matches, so both NULL-key groups count as missing on the other side
    j = ak.join(bk, on=key, how="full_outer")
    return j.agg(
        F.coalesce(F.sum(F.when(F.col("_nb").isNull(), F.col("_na"))), F.lit(0)).cast("bigint").alias(a_not_b),
        F.coalesce(F.sum(F.when(F.col("_na").isNull(), F.col("_nb"))), F.lit(0)).cast("bigint").alias(b_not_a),
    )


def distinct_keys(df: DataFrame, keys) -> DataFrame:
    """DISTINCT keys."""
    return df.select(*_keys(keys)).distinct()


# --- value ranges and histograms ---------------------------------------------

def top_values(df: DataFrame, col: str, where: Column | None = None,
               top: int = 20, count_col: str = "n") -> DataFrame:
    """Histogram of ``col`` over rows matching ``where``, top ``top`` by count (A3 + T1).

    Ties are broken by value ascending, NULL last (the order of ties is ours).
    The limit is the feature (a top-k report); Spark plans it as a per-partition
    top-k followed by one small merge.
    """
    src = df if where is None else df.where(where)
    return (src.groupBy(col).agg(F.count(_one()).alias(count_col))
               .orderBy(F.col(count_col).desc(), F.col(col).asc_nulls_last())
               .limit(top))


def range_violation(col: str, kind: str, lo, hi, guard: Column | None = None) -> Column:
    """Predicate: value fails the cast or lies outside [lo, hi] (P8), under an optional guard.

    ``guard`` uses SQL WHERE semantics (NULL drops the row), e.g.
    ``~F.col(c).isin('N/A', '')`` (P7) or ``nonblank(c)`` (P9).
    """
    v = cast_kind(col, kind)
    bad = v.isNull() | ~v.between(F.lit(lo), F.lit(hi))
    return bad if guard is None else (guard & bad)


def range_violations(df: DataFrame, col: str, kind: str, lo, hi,
                     guard: Column | None = None, top: int = 20) -> DataFrame:
    """Top histogram of the values that fail the cast or lie outside [lo, hi] (P8 + A3).

    Values are counted first and only distinct ones are tested: the test names the
    count, so the optimizer does not move it below the aggregate.
    """
    src = df if guard is None else df.where(guard)
    counts = src.groupBy(col).agg(F.count(_one()).alias("n"))
    bad = F.when(F.col("n") > 0, range_violation(col, kind, lo, hi))
    return counts.where(bad).orderBy(F.col("n").desc(), F.col(col).asc_nulls_last()).limit(top)


def group_counts(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    """Count per value, the NULL group included (A4)."""
    return df.groupBy(col).agg(F.count(_one()).alias(count_col))


# --- many metrics, one scan -----------------------------------------------------

def cast_failures(df: DataFrame, kinds: Mapping[str, str],
                  tokens: Mapping[str, Sequence[str]] | None = None,
                  suffix: str = "_cast_fail") -> DataFrame:
    """Per column: non-blank values (minus allowed tokens) that fail their cast (A5).

    ``COUNTIF(c != '' AND c NOT IN tokens AND SAFE_CAST(c) IS NULL)``, all in one aggregate.
    """
    tokens = tokens or {}
    aggs = []
    for c, kind in kinds.items():
        pred = nonblank(c)
        for t in tokens.get(c, ()):
            pred = pred & (F.col(c) != F.lit(t))
        aggs.append(F.count_if(pred & cast_kind(c, kind).isNull()).alias(f"{c}{suffix}"))
    return df.agg(*aggs)


def conditional_counts(df: DataFrame, preds: Mapping[str, Column]) -> DataFrame:
    """Many COUNTIFs in one scan (A5)."""
    return df.agg(*[F.count_if(p).alias(name) for name, p in preds.items()])


def blank_rates(df: DataFrame, cols: Sequence[str], suffix: str = "_blank_rate",
                digits: int = 4, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """ROUND(COUNTIF(c IS NULL OR c = '') / COUNT(*), 4) per column, one scan.

    ``extra`` adds further named rate predicates (e.g. share of 'Not Ranked').
    """
    total = F.count(_one())
    aggs = [rate(F.count_if(blank(c)), total, digits).alias(f"{c}{suffix}") for c in cols]
    for name, pred in (extra or {}).items():
        aggs.append(rate(F.count_if(pred), total, digits).alias(name))
    return df.agg(*aggs)


# --- check suite ----------------------------------------------------------------

def check_row(check_id: str, metric: str, value_df: DataFrame, value_col: str,
              expected: float | None = None) -> DataFrame:
    """One check as a one-row frame (check_id, metric, value, expected, passed)."""
    exp = F.lit(expected).cast("double")
    v = F.col(value_col).cast("double")
    return value_df.select(
        F.lit(check_id).alias("check_id"), F.lit(metric).alias("metric"),
        v.alias("value"), exp.alias("expected"),
        F.when(exp.isNull(), F.lit(None).cast("boolean")).otherwise(v == exp).alias("passed"),
    )


def check_suite(rows: Sequence[DataFrame]) -> DataFrame:
    """Union of check rows into one result table (A11). Information-only checks
    carry no expected value and ``passed`` is NULL."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def metrics_as_checks(metrics: DataFrame, prefix: str,
                      expected: Mapping[str, float] | None = None) -> DataFrame:
    """Unpivot a one-row metrics frame into check rows without extra scans."""
    expected = expected or {}
    cols = metrics.columns
    long = metrics.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "metric", "value")
    exp_map = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(float(v)))]) \
        if expected else None
    exp = F.element_at(exp_map, F.col("metric")) if exp_map is not None else F.lit(None).cast("double")
    return long.select(
        F.concat(F.lit(prefix + ":"), F.col("metric")).alias("check_id"), F.col("metric"),
        F.col("value"), exp.alias("expected"),
        F.when(exp.isNull(), F.lit(None).cast("boolean")).otherwise(F.col("value") == exp).alias("passed"),
    )
