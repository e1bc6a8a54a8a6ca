"""The raw → staging layer and the raw-layer quality checklist, as whole jobs.

``staging_layer`` builds every typed staging table and the four link views from
a dict of raw (all-string) tables; ``quality_checklist`` runs the full checklist
over the same raw tables and returns one result table
(check_id, metric, value, expected, passed). ``checklist_reports`` returns the
row-level reports (duplicate keys, top-20 offender histograms, flag counts).

Each raw table is scanned once per group of checks that share a grouping: all
per-column counts of a table are one aggregate; key checks are partial
aggregates plus anti joins on key counts.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import NO_RATING, NOT_RANKED, blank, cast_kind, nonblank, rate
from ..operators import quality as qa
from ..operators import staging

# Check ranges.
RATING_RANGE = (1, 10)
WEIGHT_RANGE = (0, 5)
YEAR_RANGE = (1900, 2027)


# --- staging -----------------------------------------------------------------------

def staging_layer(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Typed staging tables and link views from raw tables.

    Order matters only logically: item details take their year from staged
    item_info, so item_info is staged first.
    """
    out: dict[str, DataFrame] = {}
    if "user_info" in raw:
        out["stg_user_info"] = staging.stage_table(raw["user_info"], "user_info")
    if "item_info" in raw:
        out["stg_item_info"] = staging.stage_table(raw["item_info"], "item_info")
    if "item_details" in raw and "stg_item_info" in out:
        out["stg_item_details"] = staging.stage_item_details(raw["item_details"], out["stg_item_info"])
    if "user_item" in raw:
        out["stg_user_item"] = staging.stage_table(raw["user_item"], "user_item")
    if "item_link" in raw:
        out["stg_item_link"] = staging.stage_table(raw["item_link"], "item_link")
        for name, lt, ida, va in staging.LINK_VIEWS:
            out[name] = staging.link_view(out["stg_item_link"], lt, ida, va)
    return out


# --- checklist -------------------------------------------------------------------------

def _rating_bad():
    return range_bad("user_rating", "double", *RATING_RANGE, guard=~F.col("user_rating").isin(NO_RATING, ""))


def range_bad(col, kind, lo, hi, guard=None):
    return qa.range_violation(col, kind, lo, hi, guard)


def _weight_bad():
    return range_bad("avg_weights", "double", *WEIGHT_RANGE, guard=nonblank("avg_weights"))


def _year_bad():
    return range_bad("yearpublished", "int", *YEAR_RANGE)


def _refid_bad():
    return cast_kind("ref_id", "int").isNull()


def quality_checklist(raw: Mapping[str, DataFrame]) -> DataFrame:
    """All raw-layer checks as rows (A11): uniqueness, referential integrity,
    ranges, cast failures, blank rates, flag shares and adapter checks.

    Checks with a known expectation (0) carry it; the rest are information only.
    """
    ui, ii, uit, det, lnk = (raw[t] for t in ("user_info", "item_info", "user_item", "item_details", "item_link"))
    rows = [
        # 1. uniqueness
        qa.check_row("1-1", "duplicate_user_ids", qa.duplicate_key_count(ui, "user_id", "v"), "v", 0),
        qa.check_row("1-2", "duplicate_objectids", qa.duplicate_key_count(ii, "objectid", "v"), "v", 0),
        qa.check_row("1-3", "duplicate_pairs", qa.duplicate_key_count(uit, ["user_id", "objectid"], "v"), "v"),
        # 2. referential integrity
        qa.check_row("2-1", "orphan_rows", qa.orphan_rows(uit, ii, "objectid", "v"), "v", 0),
        qa.check_row("2-2", "orphan_rows", qa.orphan_rows(lnk, ii, "objectid", "v"), "v", 0),
    ]
    diff = qa.key_difference(det, ii, "objectid", "in_details_not_info", "in_info_not_details")
    rows.append(qa.metrics_as_checks(diff, "2-3"))
    # 3 + 4 + 5: one scan per table
    item_metrics = ii.agg(
        F.count_if(_year_bad()).alias("yearpublished_out_of_range"),
        *[F.count_if(nonblank(c) & cast_kind(c, k).isNull()).alias(f"{c}_cast_fail")
          for c, k in (("numowned", "int"), ("average", "double"), ("bayesaverage", "double"), ("stddev", "double"))],
        F.count_if(nonblank("rank") & (F.col("rank") != NOT_RANKED) & cast_kind("rank", "int").isNull())
         .alias("rank_cast_fail"),
        rate(F.count_if(blank("rank")), F.count(F.lit(1))).alias("rank_blank_rate"),
        rate(F.count_if(F.col("rank") == NOT_RANKED), F.count(F.lit(1))).alias("rank_not_ranked_rate"),
    )
    rows.append(qa.metrics_as_checks(item_metrics, "3-4/4-2", expected={
        "numowned_cast_fail": 0, "average_cast_fail": 0, "bayesaverage_cast_fail": 0, "stddev_cast_fail": 0,
        "rank_cast_fail": 0}))
    ui_rates = qa.blank_rates(ui, ["yearregistered", "lastlogin", "country", "stateorprovince", "traderating"])
    rows.append(qa.metrics_as_checks(ui_rates, "4-1"))
    uit_metrics = uit.agg(
        F.count_if(_rating_bad()).alias("user_rating_out_of_range"),
        *[rate(F.count_if(blank(c)), F.count(F.lit(1))).alias(f"{c}_blank_rate")
          for c in ("user_rating", "comment", "own", "want", "wishlist", "lastmodified")],
        rate(F.count_if(F.col("own") == "1"), F.count(F.lit(1))).alias("own_1_share"),
    )
    rows.append(qa.metrics_as_checks(uit_metrics, "3-1/4-3/5", expected={"user_rating_out_of_range": 0}))
    det_metrics = det.agg(F.count_if(_weight_bad()).alias("avg_weights_out_of_range"))
    rows.append(qa.metrics_as_checks(det_metrics, "3-2", expected={"avg_weights_out_of_range": 0}))
    # 6. adapter checks
    rows.append(qa.check_row("6-1", "items_without_any_link", qa.orphan_rows(det, lnk, "objectid", "v"), "v", 0))
    rows.append(qa.check_row("6-2", "non_numeric_ref_id", lnk.agg(F.count_if(_refid_bad()).alias("v")), "v", 0))
    return qa.check_suite(rows)


def checklist_reports(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Row-level reports of the checklist: offending keys and top-20 histograms, of
    the tables that ``raw`` has."""
    reports = {
        "duplicate_user_ids": ("user_info", lambda t: qa.duplicate_keys(t, "user_id")),
        "duplicate_objectids": ("item_info", lambda t: qa.duplicate_keys(t, "objectid")),
        "user_rating_out_of_range": ("user_item", lambda t: qa.top_values(t, "user_rating", _rating_bad())),
        "avg_weights_out_of_range": ("item_details", lambda t: qa.top_values(t, "avg_weights", _weight_bad())),
        "yearpublished_out_of_range": ("item_info", lambda t: qa.top_values(t, "yearpublished", _year_bad())),
        "own_counts": ("user_item", lambda t: qa.group_counts(t, "own")),
        "non_numeric_ref_id": ("item_link", lambda t: qa.top_values(t, "ref_id", _refid_bad())),
    }
    return {name: report(raw[t]) for name, (t, report) in reports.items() if t in raw}
