"""Analyses kept as small mergeable states, so new data needs no old rows (D1–D3, D5, D6; definitions ours).

``active_bitmaps`` turns an activity log into one bitmap of 32,768 users per
(month, bucket); logs of further batches are or-ed in (``merge_bitmaps``), and
``bitmap_retention`` answers monthly cohort retention from the bitmaps alone.
``total_sketches`` keeps a KLL sketch of per-user totals per user bucket, so a batch
only redoes the buckets of its users; ``sketch_cuts`` merges them to cut points.
``nested_funnel`` folds one scan of user × item rows to a bit set per user and
a value → count table that gives all its stages and the limit of heavy users.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import rate
from ..session import materialize

# --- D2 D3 bitmap cohorts ---------------------------------------------------------------


def active_bitmaps(activity: DataFrame, user: str, ts_col: str) -> DataFrame:
    """(month, bucket, users): bitmaps of the users (non-negative longs) active in each month. Null users and times are left out."""
    u = F.col(user).cast("long")
    months = activity.select(F.trunc(F.col(ts_col), "month").alias("month"), u.alias("u")).where("month IS NOT NULL AND u IS NOT NULL").distinct()
    return months.groupBy("month", F.bitmap_bucket_number("u").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("u")).alias("users"))


def merge_bitmaps(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after a batch: only bitmaps travel, 4 KB per (month, bucket)."""
    return state.unionByName(batch).groupBy("month", "bucket").agg(F.bitmap_or_agg("users").alias("users"))


def bitmap_retention(state: DataFrame) -> DataFrame:
    """Rows of ``marts.monthly_retention`` from the bitmaps.

    The users of cohort c active in month m are those active in both and in no
    month before c; there is no and-not of bitmaps, so their number is the size
    of c ∩ m less the size of c ∩ m ∩ earlier(c). Everything happens inside a
    bucket; a bucket holds at most one bitmap a month.
    """
    earlier = F.bitmap_or_agg("users").over(Window.partitionBy("bucket").orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    cohorts = state.select("bucket", F.col("month").alias("cohort_month"), F.col("users").alias("c"), earlier.alias("seen"))
    pairs = cohorts.join(state.select("bucket", "month", F.col("users").alias("m")), "bucket").where("month >= cohort_month")
    key = ["bucket", "cohort_month", "month"]
    both = pairs.select(*key, "seen", F.explode(F.array("c", "m")).alias("users")).groupBy(*key).agg(
        F.bitmap_and_agg("users").alias("both"), F.first("seen").alias("seen"))
    old = both.select(*key, "both", F.explode(F.array("both", F.coalesce("seen", F.lit(bytearray(4096))))).alias("x")).groupBy(*key).agg(
        F.first("both").alias("both"), F.bitmap_and_agg("x").alias("old"))
    per = (old.groupBy("cohort_month", F.months_between("month", "cohort_month").cast("int").alias("month_offset"))
           .agg(F.sum(F.bitmap_count("both") - F.bitmap_count("old")).alias("active_users")).where("active_users > 0"))
    size = F.max(F.when(F.col("month_offset") == 0, F.col("active_users"))).over(Window.partitionBy("cohort_month"))
    return per.withColumn("cohort_size", size).select("cohort_month", "month_offset", "active_users", "cohort_size",
                                                      rate(F.col("active_users"), F.col("cohort_size")).alias("retention"))


# --- D5 D6 quantile sketches ---------------------------------------------------------------

#: Size of a sketch and the rank error (share of all users) that cut points of merged sketches keep to.
SKETCH_K, RANK_ERROR = 400, 0.02


def total_sketches(per_user: DataFrame, user: str, total: str, buckets: int = 64, k: int = SKETCH_K) -> DataFrame:
    """(bucket, sketch): a KLL sketch of the totals of each bucket of users. Buckets
    are disjoint in users, so those without new rows stay as they are."""
    bucket = F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int").alias("bucket")
    return per_user.where(F.col(total).isNotNull()).groupBy(bucket).agg(F.kll_sketch_agg_bigint(F.col(total).cast("long"), F.lit(k)).alias("sketch"))


def replace_sketches(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """The state with the sketches of ``fresh`` in place of those of the same buckets."""
    return state.join(fresh.select("bucket"), "bucket", "left_anti").unionByName(fresh)


def sketch_cuts(state: DataFrame, shares: list[float]) -> DataFrame:
    """(share, cut): cut points of all buckets' sketches merged."""
    merged = state.agg(F.kll_merge_agg_bigint("sketch").alias("s"))
    return merged.select(F.explode(F.array(*[F.struct(F.lit(q).alias("share"), F.kll_sketch_get_quantile_bigint("s", F.lit(q)).alias("cut"))
                                             for q in shares])).alias("r")).select("r.share", "r.cut")


def rank_errors(cuts: DataFrame, per_user: DataFrame, total: str) -> DataFrame:
    """(share, cut, rank_error): how far, as a share of all users, the asked share lies
    outside the exact ranks of each cut (0 if equal totals span it)."""
    rows = cuts.collect()     # one row per cut point
    t = F.col(total)
    n = F.count(t)
    exact = per_user.agg(*[F.struct(F.lit(r.share).alias("share"), F.lit(r.cut).alias("cut"), (F.count_if(t < r.cut) / n).alias("low"),
                                    (F.count_if(t <= r.cut) / n).alias("high")).alias(f"c{i}") for i, r in enumerate(rows)])
    e = exact.select(F.explode(F.array(*[f"c{i}" for i in range(len(rows))])).alias("r")).select("r.*")
    return e.select("share", "cut", F.greatest(F.col("low") - F.col("share"), F.col("share") - F.col("high"), F.lit(0.0)).alias("rank_error"))


# --- D1 nested funnel ---------------------------------------------------------------

STAGES = ("own", "rate", "play", "heavy")


def nested_funnel(user_item: DataFrame, user: str, own: str, rating: str, plays: str) -> DataFrame:
    """own → rate → play → heavy, each stage inside the one before (D1; definition ours).

    A user owns if some item of theirs is owned, rates if some owned one has a
    rating, plays if some owned and rated one was played, and is heavy if,
    beyond that, their plays of all items exceed the upper tertile cut (linear
    interpolation, as D5) of the totals of all users that play. One scan folds
    rows to (bit set, total) per user; users to a (bits, total) → count table,
    which gives the cut and all stages.
    """
    owned = F.coalesce(F.col(own), F.lit(False))
    rated = owned & F.col(rating).isNotNull()
    played = rated & (F.coalesce(F.col(plays), F.lit(0)) > 0)
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate((owned, rated, played))), F.lit(0))
    per_user = user_item.where(F.col(user).isNotNull()).groupBy(user).agg(
        F.bit_or(bits).alias("bits"), F.sum(F.coalesce(F.col(plays), F.lit(0))).cast("long").alias("total"))
    counts = materialize(per_user.groupBy("bits", "total").agg(F.count(F.lit(1)).alias("n")), "funnel-counts")
    cut = counts.where("bits >= 4").agg(F.percentile(F.col("total").cast("double"), F.lit(2.0 / 3), F.col("n"))).first()[0]
    reached = [F.col("bits") >= 1, F.col("bits") >= 2, F.col("bits") >= 4,
               (F.col("bits") >= 4) & (F.col("total") > F.lit(cut if cut is not None else 0.0))]
    sums = counts.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(s) for c, s in zip(reached, STAGES, strict=True)])
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(k + 1).alias("stage_no"), F.lit(s).alias("stage"), F.col(s).alias("users"))
                                          for k, s in enumerate(STAGES)])).alias("r")).select("r.*")
    prev = F.lag("users").over(Window.orderBy("stage_no"))          # four rows
    return out.select("stage_no", "stage", "users", rate(F.col("users"), prev).alias("conversion"), (prev - F.col("users")).alias("drop_off"))
