"""The raw-layer checklist from stored states (A11, A5, A6): a table's rows are read once, when they are loaded.

All row checks of a table are one set of counters, taken as an ``Observation`` on
the load's own write (in its last stage, so a rerun task counts once), and its
key checks need the number of rows per key, counted from the key columns of what
was written. Both are stored per batch and merge by addition, so the
checklist of a layer that grew by a batch reads no raw row of older batches, and
all checks across tables come from one aggregate over the merged key counts.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import blank, cast_kind, nonblank, rate
from ..operators import quality as qa
from ..operators.ingest_state import append_unit_rows
from ..streaming.landing import table_or_none
from . import warehouse

# The key whose rows are counted per table.
KEYS = {"user_info": ["user_id"], "item_info": ["objectid"], "user_item": ["user_id", "objectid"],
        "item_details": ["objectid"], "item_link": ["objectid"]}
_ROWS = "rows"


def _blank_counts(*columns: str) -> dict[str, Column]:
    return {f"{c}_blank_rate": blank(c) for c in columns}


def counters(table: str) -> dict[str, Column]:
    """Metric → predicate whose rows are counted; a metric named ``…_rate`` or ``…_share`` is shown as a share of all rows."""
    if table == "item_info":
        kinds = {"numowned": "int", "average": "double", "bayesaverage": "double", "stddev": "double"}
        ranked = nonblank("rank") & (F.col("rank") != warehouse.NOT_RANKED)
        return {"yearpublished_out_of_range": warehouse._year_bad(),
                **{f"{c}_cast_fail": nonblank(c) & cast_kind(c, k).isNull() for c, k in kinds.items()},
                "rank_cast_fail": ranked & cast_kind("rank", "int").isNull(),
                **_blank_counts("rank"), "rank_not_ranked_rate": F.col("rank") == warehouse.NOT_RANKED}
    if table == "user_info":
        return _blank_counts("yearregistered", "lastlogin", "country", "stateorprovince", "traderating")
    if table == "user_item":
        return {"user_rating_out_of_range": warehouse._rating_bad(),
                **_blank_counts("user_rating", "comment", "own", "want", "wishlist", "lastmodified"), "own_1_share": F.col("own") == "1"}
    if table == "item_details":
        return {"avg_weights_out_of_range": warehouse._weight_bad()}
    return {"non_numeric_ref_id": warehouse._refid_bad()} if table == "item_link" else {}


# Table → (check prefix, expected values) of its counters.
_LISTED = {"item_info": ("3-4/4-2", ("numowned_cast_fail", "average_cast_fail", "bayesaverage_cast_fail", "stddev_cast_fail", "rank_cast_fail")),
           "user_info": ("4-1", ()), "user_item": ("3-1/4-3/5", ("user_rating_out_of_range",)), "item_details": ("3-2", ("avg_weights_out_of_range",))}


def load(df: DataFrame, table: str, raw_dir: str, state_dir: str, batch_id: int) -> int:
    """Append a batch to raw table ``table`` and store its check states; returns its
    rows. Loading a batch again replaces its rows and its states."""
    spark, obs = df.sparkSession, Observation()
    found = {m: F.count_if(p).alias(m) for m, p in counters(table).items()}
    path = f"{raw_dir}/{table}"
    append_unit_rows(df.observe(obs, F.count(F.lit(1)).alias(_ROWS), *found.values()).withColumn("batch_id", F.lit(batch_id)), path)
    seen = obs.get
    rows = [(table, m, int(seen[m])) for m in (_ROWS, *found)]
    append_unit_rows(spark.createDataFrame(rows, "tab string, metric string, n long").withColumn("batch_id", F.lit(batch_id)),
                     f"{state_dir}/counters/{table}")
    if seen[_ROWS]:
        keys = spark.read.parquet(path).where(F.col("batch_id") == batch_id).groupBy(*KEYS[table]).agg(F.count(F.lit(1)).alias("n"))
        append_unit_rows(keys.withColumn("batch_id", F.lit(batch_id)), f"{state_dir}/keys/{table}")
    return int(seen[_ROWS])


def _key_counts(spark: SparkSession, state_dir: str) -> dict[str, DataFrame]:
    """Per table: rows per key over all batches."""
    found = {t: table_or_none(spark, f"{state_dir}/keys/{t}") for t in KEYS}
    empty = {t: spark.createDataFrame([], ", ".join(f"{c} string" for c in k) + ", n long") for t, k in KEYS.items()}
    return {t: (empty[t] if found[t] is None else found[t]).groupBy(*k).agg(F.sum("n").alias("n")) for t, k in KEYS.items()}


def checklist(spark: SparkSession, state_dir: str) -> DataFrame:
    """The rows of ``warehouse.quality_checklist`` from the stored states of all batches."""
    keys = _key_counts(spark, state_dir)
    doubled = lambda t: keys[t].agg(F.count_if(F.col("n") > 1).alias("v"))
    rows = [qa.check_row("1-1", "duplicate_user_ids", doubled("user_info"), "v", 0),
            qa.check_row("1-3", "duplicate_pairs", doubled("user_item"), "v")]
    rows.append(_item_checks({t: k for t, k in keys.items() if t != "user_info"}))
    for table, (prefix, zero) in _LISTED.items():
        rows.append(_counter_checks(spark, state_dir, table, prefix, zero))
    links = spark.read.parquet(f"{state_dir}/counters/item_link").where("metric = 'non_numeric_ref_id'").agg(F.sum("n").alias("v"))
    rows.append(qa.check_row("6-2", "non_numeric_ref_id", links, "v", 0))
    return qa.check_suite(rows)


def _item_checks(keys: Mapping[str, DataFrame]) -> DataFrame:
    """Uniqueness and integrity of item keys: one aggregate over the tables' key counts.
    A NULL key matches nothing, itself included."""
    every = None
    for t, k in keys.items():
        part = k.groupBy("objectid").agg(F.sum("n").alias("n")).select("objectid", *[F.when(F.lit(t == o), F.col("n")).alias(o) for o in keys])
        every = part if every is None else every.unionByName(part)
    per = every.groupBy("objectid").agg(*[F.max(o).alias(o) for o in keys])
    null = F.col("objectid").isNull()
    lacks = lambda o: null | F.col(o).isNull()
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0)).cast("double")
    # check id, metric, value, expected
    checks = [("1-2", "duplicate_objectids", F.count_if(F.col("item_info") > 1).cast("double"), 0.0),
              ("2-1", "orphan_rows", total("user_item", lacks("item_info")), 0.0),
              ("2-2", "orphan_rows", total("item_link", lacks("item_info")), 0.0),
              ("2-3:in_details_not_info", "in_details_not_info", total("item_details", lacks("item_info")), None),
              ("2-3:in_info_not_details", "in_info_not_details", total("item_info", lacks("item_details")), None),
              ("6-1", "items_without_any_link", total("item_details", lacks("item_link")), 0.0)]
    one = per.agg(*[v.alias(f"v{i}") for i, (_, _, v, _) in enumerate(checks)])
    listed = F.array(*[F.struct(F.lit(c).alias("check_id"), F.lit(m).alias("metric"), F.col(f"v{i}").alias("value"),
                                F.lit(e).cast("double").alias("expected")) for i, (c, m, _, e) in enumerate(checks)])
    return one.select(F.explode(listed).alias("r")).select("r.*").withColumn("passed", F.col("value") == F.col("expected"))


def _counter_checks(spark: SparkSession, state_dir: str, table: str, prefix: str, zero: tuple[str, ...]) -> DataFrame:
    sums = spark.read.parquet(f"{state_dir}/counters/{table}").groupBy("metric").agg(F.sum("n").alias("n"))
    # a dozen metrics: one row with a column for each
    names = list(counters(table))
    wide = sums.agg(*[F.max(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in (_ROWS, *names)])
    shown = [rate(F.col(m), F.col(_ROWS)).alias(m) if m.endswith(("_rate", "_share")) else F.col(m) for m in names]
    return qa.metrics_as_checks(wide.select(*shown), prefix, expected={m: 0 for m in zero} or None)
