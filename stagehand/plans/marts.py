"""Analyses on top of staging.

The source project names these analyses (funnel, cohort retention, wish-vs-play,
segments, trends, one-hot item features, coverage) but ships no code or metric
document for them. The definitions below are OURS and say so; each one is a
plain DataFrame plan built from partial aggregates and joins on small
per-user/per-item tables, so no user or item — however hot — is ever gathered
into a single task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import rate
from ..operators.arg_extreme import extreme_row
from ..operators.joins import bounded_broadcast
from ..operators.ranking import exact_percentiles
from ..operators.sampling import wilson_interval
from ..session import materialize, shared_dir

def _one():
    return F.lit(1)


# --- D1 funnel -------------------------------------------------------------------

def ordered_funnel(events: DataFrame, user: str, stage_col: str, ts_col: str,
                   stages: Sequence[str]) -> DataFrame:
    """Ordered funnel with drop-off (D1; definition ours).

    A user reaches stage k when they have a stage-k event at or after the time
    they reached stage k-1; the time of reaching stage k is the earliest such
    event. Computed stage by stage: each step reads only that stage's events,
    joins the per-user table of the previous step (one row per user) and takes
    a per-user ``min`` (partial aggregate). Output: one row per stage with users,
    conversion from the previous stage, and drop-off.

    The per-user table of each stage is checkpointed to the shared checkpoint
    folder, so stage k scans only its own events instead of replaying stages
    1..k-1 (the plan would otherwise grow quadratically with the stage count).
    """
    shared_dir(events.sparkSession)          # make sure a reliable checkpoint folder is set
    reached = None
    counts = []
    for k, stage in enumerate(stages):
        ev = events.where(F.col(stage_col) == F.lit(stage)).select(user, F.col(ts_col).alias("_ts"))
        if reached is not None:
            # broadcast the per-user table when its size is proven small: the events
            # then never shuffle, so a user holding a third of them costs nothing
            # extra; above the bound it is a shuffle join that AQE splits when skewed
            ev = ev.join(bounded_broadcast(reached), on=user).where(F.col("_ts") >= F.col("_prev"))
        reached = ev.groupBy(user).agg(F.min("_ts").alias("_prev")).checkpoint(eager=True)
        counts.append(reached.agg(F.count(_one()).alias("users"))
                             .select(F.lit(k + 1).alias("stage_no"), F.lit(stage).alias("stage"), "users"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    # one row per stage: a bounded table, so a global window is fine
    prev = F.lag("users").over(Window.orderBy("stage_no"))
    return out.select("stage_no", "stage", "users",
                      rate(F.col("users"), prev).alias("conversion"),
                      (prev - F.col("users")).alias("drop_off"))


# --- D2 / D14 cohorts ---------------------------------------------------------------

def user_activity_span(activity: DataFrame, user: str, ts_col: str) -> DataFrame:
    """Per user: first and last activity (registration / last-login proxy)."""
    return activity.groupBy(user).agg(F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"))


def cohort_by_year(users: DataFrame, cohort_col: str, last_col: str) -> DataFrame:
    """Cohort retention proxy (D2; definition ours): cohort = registration year,
    years_active = year(last activity) − cohort; share of the cohort per offset,
    with a Wilson interval (D12) because early cohorts are small."""
    per = (users.select(F.col(cohort_col).alias("cohort"),
                        (F.year(F.col(last_col)) - F.col(cohort_col)).alias("years_active"))
                .groupBy("cohort", "years_active").agg(F.count(_one()).alias("users")))
    size = F.sum("users").over(Window.partitionBy("cohort"))
    per = per.withColumn("cohort_size", size)
    ci = wilson_interval(F.col("users"), F.col("cohort_size"))
    return per.select("cohort", "years_active", "users", "cohort_size",
                      rate(F.col("users"), F.col("cohort_size")).alias("share"),
                      F.round(ci["lo"], 4).alias("ci_lo"), F.round(ci["hi"], 4).alias("ci_hi"))


def cohort_distribution(users: DataFrame, year_col: str) -> DataFrame:
    """Users per cohort year and share of all users."""
    per = users.groupBy(F.col(year_col).alias("cohort")).agg(F.count(_one()).alias("users"))
    total = F.sum("users").over(Window.partitionBy())
    return per.select("cohort", "users", rate(F.col("users"), total).alias("share"))


# --- D3 monthly retention ---------------------------------------------------------------

def monthly_retention(activity: DataFrame, user: str, ts_col: str) -> DataFrame:
    """True monthly cohort retention from an activity log (D3; definition ours).

    cohort = month of a user's first activity; offset = whole months from the
    cohort month to an active month. One scan: (user, month) pairs are distinct
    first, so a very active user has one row per month, and the window over a
    user is bounded by the months. Everyone is active in the first month, so the
    cohort's size is its row at offset 0.
    """
    months = activity.select(user, F.trunc(F.col(ts_col), "month").alias("month")).distinct()
    first = F.min("month").over(Window.partitionBy(user))
    per = (months.select("month", first.alias("cohort_month"))
                 .select("cohort_month", F.months_between("month", "cohort_month").cast("int").alias("month_offset"))
                 .groupBy("cohort_month", "month_offset").agg(F.count(_one()).alias("active_users")))
    size = F.max(F.when(F.col("month_offset") == 0, F.col("active_users"))).over(Window.partitionBy("cohort_month"))
    return (per.withColumn("cohort_size", size)
               .select("cohort_month", "month_offset", "active_users", "cohort_size",
                       rate(F.col("active_users"), F.col("cohort_size")).alias("retention")))


# --- D4 wished but unplayed ---------------------------------------------------------------

def wish_vs_play(items: DataFrame, key: str, plays: str, wishing: str,
                 traits: DataFrame, trait: str) -> DataFrame:
    """Play-to-wish ratio and wished-but-unplayed share per trait (D4; definition ours).

    ``items``: one row per item with total plays and wishing count. An item is
    wished-but-unplayed when wishing > 0 and plays = 0. ``traits`` is a bridge
    (item, trait); items without a trait are kept under NULL (left join).
    """
    it = items.select(key, F.col(plays).alias("_plays"), F.col(wishing).alias("_wish"),
                      F.try_divide(F.col(plays).cast("double"), F.col(wishing).cast("double")).alias("_ratio"))
    j = it.join(traits.select(key, trait), on=key, how="left")
    return j.groupBy(trait).agg(
        F.count(_one()).alias("items"),
        F.count_if((F.col("_wish") > 0) & (F.col("_plays") == 0)).alias("wished_unplayed"),
        F.round(F.avg("_ratio"), 4).alias("avg_play_to_wish"),
    ).withColumn("wished_unplayed_share", rate(F.col("wished_unplayed"), F.col("items")))


# --- D5 / D6 segments ---------------------------------------------------------------------

def tertile_segments(per_user: DataFrame, user: str, total: str,
                     max_exact_values: int = 1_000_000) -> DataFrame:
    """Light/medium/heavy by tertile cut points of a per-user total (D5; ours).

    Cut points are exact at any size, linear interpolation as Spark's
    ``percentile`` defines it. Up to ``max_exact_values`` distinct totals that
    aggregate computes them in one pass (its buffer is a value→count map merged
    map-side, so only distinct totals travel; play counts have few). Beyond that
    bound its single final merge would grow with the data, so the order
    statistics are found from range-partitioned cumulative counts instead
    (``ranking.exact_percentiles``): same values, no task holding them all.
    Users with equal totals always share a segment.
    """
    # the totals feed three passes (size, cut points, labels): compute them once
    per_user = materialize(per_user.select(user, total), "per-user-totals")
    t = F.col(total).cast("double")
    distinct = per_user.agg(F.approx_count_distinct(t).alias("d")).first()["d"]
    if distinct <= max_exact_values:
        q = per_user.agg(F.percentile(t, [1.0 / 3, 2.0 / 3]).alias("_q")).first()[0]
    else:
        q = exact_percentiles(per_user, total, [1.0 / 3, 2.0 / 3], n_values=distinct)
    if q is None:
        return per_user.select(user, total, F.lit(None).cast("string").alias("segment"))
    seg = (F.when(t <= F.lit(float(q[0])), F.lit("light"))
            .when(t <= F.lit(float(q[1])), F.lit("medium"))
            .otherwise(F.lit("heavy")))
    return per_user.select(user, total, seg.alias("segment"))


def count_range_segment(per_user: DataFrame, count_col: str, lo: int = 11, hi: int = 109) -> Column:
    """Alternative heavy-user rule (D6, not adopted by the source): lo ≤ count ≤ hi."""
    return F.col(count_col).between(lo, hi)


# --- D7 trend --------------------------------------------------------------------------------

def trend_share(facts: DataFrame, fact_key: str, year_col: Column, dims: DataFrame,
                dim_key: str, category: str) -> DataFrame:
    """Facts per (year, category) and the category's share of the year (D7; ours).

    Facts are pre-aggregated to (key, year) before the join, so a hot item costs
    one row per map task; the join then meets the dimension on aggregated rows.
    """
    pre = facts.groupBy(F.col(fact_key).alias(dim_key), year_col.alias("year")).agg(F.count(_one()).alias("_n"))
    j = pre.join(dims.select(dim_key, category), on=dim_key, how="left")
    per = j.groupBy("year", category).agg(F.sum("_n").cast("bigint").alias("n"))
    total = F.sum("n").over(Window.partitionBy("year"))
    return per.select("year", category, "n", rate(F.col("n"), total).alias("share"))


# --- D8 weighted one-hot -----------------------------------------------------------------------

def weighted_features(links: DataFrame, key: str, feature: str) -> DataFrame:
    """Long-format weighted one-hot (D8): weight = 1 / number of features of the item.

    Per-item counts come from a partial aggregate joined back, not a window over
    the item, so a heavily linked item is never gathered into one task.
    """
    pairs = links.select(key, feature).distinct()
    per_item = pairs.groupBy(key).agg(F.count(_one()).alias("_k"))
    return (pairs.join(per_item, on=key)
                 .select(key, feature, F.round(F.lit(1.0) / F.col("_k"), 6).alias("weight")))


def one_hot_wide(weighted: DataFrame, key: str, feature: str, values: Sequence[str]) -> DataFrame:
    """Wide matrix for an explicit feature list (pivot needs the values up front)."""
    return weighted.groupBy(key).pivot(feature, list(values)).agg(F.first("weight")).na.fill(0.0)


# --- D9 latest per name ---------------------------------------------------------------------

def latest_per_key(df: DataFrame, key: str, order_cols: Sequence[str], keep: Sequence[str], reread: bool = False) -> DataFrame:
    """Keep the latest row per key (D9), by a hash aggregate where the order packs
    (``arg_extreme``; ``reread``: the input may be read twice for wide columns)."""
    return extreme_row(df, key, order_cols, keep, last=True, reread=reread).select(key, *keep)


# --- D13 coverage ---------------------------------------------------------------------------

def join_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Share of left rows with at least one match on the right.

    Both sides are reduced to per-key rows map-side (left: key counts, right:
    distinct keys) before the join, so a key holding a third of the left rows
    travels as one row per task, and left rows are never multiplied by duplicate
    right keys. A NULL key never matches.
    """
    lk = left.groupBy(key).agg(F.count(_one()).alias("_n"))
    rk = right.select(key).distinct().withColumn("_m", F.lit(True))
    j = lk.join(rk, on=key, how="left")
    total = F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint")
    matched = F.coalesce(F.sum(F.when(F.col("_m"), F.col("_n"))), F.lit(0)).cast("bigint")
    return j.agg(total.alias("total"), matched.alias("matched"),
                 (total - matched).alias("unmatched"), rate(matched, total).alias("coverage"))
