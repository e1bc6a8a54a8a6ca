"""Plan shape: aggregation happens map-side before any exchange; co-located joins skip shuffles."""
from pyspark.sql import functions as F

from stagehand.operators import ingest_state as ing
from stagehand.operators import quality as qa
from stagehand.operators import staging
from stagehand.plans import marts
from conftest import plan_text


def _hot(spark, n=30000):
    # one key holds a third of all rows
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                 F.col("id").alias("v"))


def _partial_before_exchange(plan: str, fn: str) -> bool:
    # executed plans print top-down: the partial aggregate sits below (after) the first Exchange
    ex = plan.find("Exchange")
    return ex != -1 and plan.find(f"partial_{fn}", ex) != -1


def test_key_checks_aggregate_map_side(spark):
    df = _hot(spark)
    dim = spark.range(100).select(F.col("id").alias("k"))
    assert _partial_before_exchange(plan_text(qa.orphan_rows(df, dim, "k")), "count")
    assert _partial_before_exchange(plan_text(qa.duplicate_keys(df, "k")), "count")
    assert _partial_before_exchange(plan_text(ing.first_seen(df, "k", ["v"])), "min_by")
    assert _partial_before_exchange(plan_text(marts.latest_per_key(df, "k", ["v"], ["v"])), "max_by")
    assert _partial_before_exchange(plan_text(marts.join_coverage(df, dim, "k")), "count")
    assert qa.orphan_rows(df, dim, "k").first()[0] == sum(1 for i in range(30000) if i % 3 and i >= 100)


def test_packed_orders_aggregate_by_hash(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("unit_id"), F.lit("done").alias("state"),
                                    F.lit(None).cast("string").alias("reason"), F.col("id").alias("batch_id"))
    for out in (ing.first_seen(_hot(spark), "k", ["v"]), marts.latest_per_key(_hot(spark), "k", ["v"], ["v"]), ing.latest_state(rows)):
        plan = plan_text(out)
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_no_window_over_hot_key(spark):
    for out in (ing.first_seen(_hot(spark), "k", ["v"]), qa.duplicate_keys(_hot(spark), "k")):
        assert "Window" not in plan_text(out)


def test_bucketed_tables_join_without_shuffle(spark, tmp_dir):
    a = spark.range(5000).select((F.col("id") % 1000).cast("string").alias("objectid"), F.col("id").alias("x"))
    b = spark.range(1000).select(F.col("id").cast("string").alias("objectid"), (F.col("id") * 2).alias("y"))
    staging.write_bucketed(a, "bk_a", "objectid", 8, path=tmp_dir + "/a")
    staging.write_bucketed(b, "bk_b", "objectid", 8, path=tmp_dir + "/b")
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("bk_a").join(spark.table("bk_b"), "objectid")
        plan = plan_text(j)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == 5000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_hot_key_join_is_split_by_aqe(spark):
    """A fact key holding a third of the rows: AQE splits its partition in the left join."""
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    prev = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        # a varying payload, so the hot partition is large in bytes too (AQE measures bytes)
        fact = _hot(spark, 60000).select("k", "v", F.lit(None).cast("bigint").alias("year"))
        dim = spark.range(60000).select(F.col("id").alias("k"), (F.col("id") % 50 + 1970).alias("first_year"))
        out = staging.enrich_left(fact, dim, "k", {"year": "first_year"})
        assert out.where(F.col("year").isNull()).count() == 0
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final
    finally:
        for k, v in prev.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_broadcast_only_behind_row_and_byte_bounds(spark):
    from stagehand.operators.joins import bounded_broadcast

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()

    small = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("s"))
    assert hinted(bounded_broadcast(small, max_rows=1000))
    assert not hinted(bounded_broadcast(small, max_rows=99))                     # too many rows
    wide = spark.range(100).select(F.col("id").alias("k"), F.repeat(F.lit("y"), 10_000).alias("s"))
    assert not hinted(bounded_broadcast(wide, max_rows=1000, max_bytes=100_000))  # ~1 MB of text
    assert hinted(bounded_broadcast(wide, max_rows=1000, max_bytes=10_000_000))
