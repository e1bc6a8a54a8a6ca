"""Reproducible sampling and sample design.

The draw is defined by a hash, not by a random generator: a row's sort key is
``md5(seed || ':' || id)``, so the sample does not depend on partitioning, task
retries or executor loss, and any engine can reproduce it.

Exact-n without sorting everything: the first 48 bits of the hash are a uniform
number u in [0, 1). Keeping rows with u < f (f chosen a little above n/N)
gives a superset that provably holds the n smallest hashes whenever it has at
least n rows (u is monotone in the hash). Only that superset — about n rows —
is sorted; if it is short, f is doubled and the filter re-run.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import bounded_broadcast


def sample_hash(id_col, seed) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), c.cast("string")))


def _uniform(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(2 ** 48))


def _margin(q: Column | float) -> Column | float:
    if isinstance(q, Column):
        return q + F.lit(6.0) * F.sqrt(q) + F.lit(16.0)
    return q + 6.0 * math.sqrt(q) + 16.0


def seeded_sample(df: DataFrame, id_col: str, n: int, seed, per_bucket: int = 100_000) -> DataFrame:
    """Exactly ``min(n, N)`` rows: the n smallest ``md5(seed:id)``, ties by id (M1).

    Rows with a NULL id cannot be drawn and do not count. The pick is distributed
    (``_smallest_by_buckets``), so no task ever holds the whole sample.
    """
    h = sample_hash(id_col, seed)
    df = df.where(F.col(id_col).isNotNull())
    total = df.count()
    f = min(1.0, _margin(float(n)) / max(total, 1))
    while True:
        # the candidates (about n rows) are written once, so the pick does not rescan df
        cand = materialize(df.withColumn("_h", h).where(_uniform(F.col("_h")) < F.lit(f)), "sample-candidates")
        got = cand.count()
        if f >= 1.0 or got >= n:
            break
        f = min(1.0, f * 2)
    return _smallest_by_buckets(cand, id_col, min(n, total), f, got, per_bucket)


def _smallest_by_buckets(cand: DataFrame, id_col: str, n: int, f: float, got: int,
                         per_bucket: int) -> DataFrame:
    """The n rows with the smallest (``_h``, id) among ``cand``, without a global sort.

    Candidates are cut by hash prefix into buckets of about ``per_bucket`` rows
    (the prefix is uniform). Buckets wholly below the n-th row are taken as they
    are; only the one bucket holding the cut is ranked, inside itself.
    """
    buckets = max(1, math.ceil(got / per_bucket))
    b = F.least(F.floor(_uniform(F.col("_h")) / F.lit(f) * buckets), F.lit(buckets - 1)).cast("bigint")
    cand = cand.withColumn("_b", b)
    counts = cand.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).orderBy("_b").collect()  # ≤ buckets rows
    before, cut, need = 0, -1, 0
    for row in counts:
        if before + row["_c"] >= n:
            cut, need = row["_b"], n - before
            break
        before += row["_c"]
    whole = cand.where(F.col("_b") < F.lit(cut))
    edge = (cand.where(F.col("_b") == F.lit(cut))
                .withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col)))
                .where(F.col("_rn") <= F.lit(need)).drop("_rn"))
    return whole.unionByName(edge).drop("_h", "_b")


def freeze(df: DataFrame, path: str) -> DataFrame:
    """Freeze a sample (M2): the first write wins, later runs read it back."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def sample_size(population: Column, z: float = 1.96, p: float = 0.5, e: float = 0.02,
                response_rate: float | None = None) -> Column:
    """Proportion sample size with finite-population correction.

    n0 = z² p (1-p) / e²;  n = n0 / (1 + (n0 - 1) / N);  optionally n / response_rate.
    Returns struct(n0, n_fpc, n_target).
    """
    n0 = z * z * p * (1 - p) / (e * e)
    n_fpc = F.lit(n0) / (F.lit(1.0) + (F.lit(n0) - 1) / population.cast("double"))
    target = n_fpc if response_rate is None else F.ceil(n_fpc / F.lit(response_rate))
    return F.struct(F.lit(n0).alias("n0"), n_fpc.alias("n_fpc"), target.cast("double").alias("n_target"))


def allocate(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """Proportional allocation (D11): quota_s = round(n · N_s / N) per stratum."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("population"))
    # the total is one number (a one-row aggregate), so however many strata there
    # are, no window gathers them all into one task
    total = counts.agg(F.sum("population")).first()[0] or 0
    return counts.withColumn("quota", F.round(F.lit(float(n)) * F.col("population")
                                              / F.lit(float(max(total, 1)))).cast("bigint"))


def stratified_sample(df: DataFrame, id_col: str, stratum: str, n: int, seed,
                      per_bucket: int = 100_000) -> DataFrame:
    """Per stratum, its quota of rows with the smallest ``md5(seed:id)`` (D11 + M1).

    NULL is a stratum like any other; rows with a NULL id cannot be drawn and do
    not count. Each stratum gets its own hash threshold from its quota and size,
    so only about ``quota`` rows per stratum reach the final window — a stratum
    holding a third of all rows is filtered map-side, never gathered into one
    task; a huge quota is itself ranked in buckets of about ``per_bucket`` rows.
    Short strata double their threshold up to 1, where they have all their rows.
    """
    # strata are joined by a text that is never NULL
    key = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("NULL"))
    df = df.where(F.col(id_col).isNotNull()).withColumn("_k", key)
    alloc = allocate(df, "_k", n)
    thr = materialize(alloc.select("_k", "quota", F.least(F.lit(1.0), _margin(F.col("quota").cast("double"))
                                                          / F.col("population")).alias("_f")), "strata-thresholds")
    h = sample_hash(id_col, seed)
    while True:
        small = bounded_broadcast(thr)
        # about n candidate rows, written once: the check and the pick read them, not df
        cand = materialize(df.withColumn("_h", h).join(small, on="_k")
                             .where(_uniform(F.col("_h")) < F.col("_f")), "strata-candidates")
        short = (cand.groupBy("_k").agg(F.count(F.lit(1)).alias("_got"))
                     .join(thr, on="_k", how="right")
                     .where((F.coalesce(F.col("_got"), F.lit(0)) < F.col("quota")) & (F.col("_f") < 1.0))
                     .select("_k", F.lit(True).alias("_grow")))
        if short.isEmpty():
            break
        grown = F.when(F.col("_grow"), F.least(F.lit(1.0), F.col("_f") * 2)).otherwise(F.col("_f"))
        thr = materialize(thr.join(short, on="_k", how="left").select("_k", "quota", grown.alias("_f")), "strata-thresholds")
    return _quota_smallest(cand, id_col, "_k", per_bucket).drop("_k")


def _quota_smallest(cand: DataFrame, id_col: str, stratum: str, per_bucket: int) -> DataFrame:
    """Per stratum, its ``quota`` candidates with the smallest (``_h``, id).

    A stratum's candidates are cut by hash prefix into buckets of about
    ``per_bucket`` rows (the prefix is uniform below the stratum's ``_f``), so a
    stratum with a huge quota is ranked in many tasks: buckets wholly under the
    quota are kept as they are, and only the bucket holding the cut is ranked,
    inside itself. Bucket counts are one row per (stratum, bucket).
    """
    nb = (cand.groupBy(stratum).agg(F.count(F.lit(1)).alias("_got"))
              .select(stratum, F.greatest(F.lit(1), F.ceil(F.col("_got") / F.lit(per_bucket))).cast("bigint").alias("_nb")))
    b = F.least(F.floor(_uniform(F.col("_h")) / F.col("_f") * F.col("_nb")), F.col("_nb") - 1).cast("bigint")
    cand = cand.join(bounded_broadcast(nb), on=stratum).withColumn("_b", b)
    counts = cand.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    cum = counts.select(stratum, "_b", "_c", F.coalesce(before, F.lit(0)).alias("_before"))
    j = cand.join(bounded_broadcast(cum), on=[stratum, "_b"])
    rn = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", id_col))
    whole = F.col("_before") + F.col("_c") <= F.col("quota")
    keep = whole | (F.col("_before") + F.col("_rn") <= F.col("quota"))
    return (j.withColumn("_rn", rn).where(keep)
             .drop("_h", "_f", "_rn", "quota", "_nb", "_b", "_c", "_before"))


def wilson_interval(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """Wilson score interval for a proportion (D12; the choice of interval is ours)."""
    n = trials.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    z2 = z * z
    denom = F.lit(1.0) + F.lit(z2) / n
    center = (p + F.lit(z2) / (F.lit(2.0) * n)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (F.lit(4.0) * n * n)) / denom
    return F.struct((center - half).alias("lo"), (center + half).alias("hi"))
