"""Bucketed tables: joins without a shuffle, lookups that read one bucket."""
from conftest import SF_SMALL, plan_text
from pyspark.sql import functions as F

from stagehand.operators import staging
from stagehand.plans import catalog


def test_join_and_grouping_without_exchange(spark):
    df = catalog.QUERIES["colocated_items_part"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Exchange" not in text.replace("BroadcastExchange", "")
    assert df.count() > 0


def test_lookup_reads_one_bucket(spark, tmp_dir):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("objectid"), (F.col("id") * 2).alias("n"))
    staging.write_colocated({"coloc_test": rows}, "objectid", 8, tmp_dir)
    t = staging.read_colocated(spark, ["coloc_test"])["coloc_test"]
    try:
        one = staging.lookup(t, "objectid", ["77"])
        assert [tuple(r) for r in one.collect()] == [("77", 154)]
        old = spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", "1g")           # one task a file
        try:
            assert one.rdd.getNumPartitions() == 1 and t.where("n >= 0").rdd.getNumPartitions() == 8
        finally:
            spark.conf.set("spark.sql.files.openCostInBytes", old)
        assert "PushedFilters: [IsNotNull(objectid), EqualTo(objectid,77)]" in plan_text(one)
        many = staging.lookup(t, "objectid", ["1", "2", "none"])
        assert sorted(map(tuple, many.collect())) == [("1", 2), ("2", 4)]
        footer = spark.read.parquet(f"{tmp_dir}/coloc_test")
        assert len(footer.inputFiles()) == 8
    finally:
        spark.sql("DROP TABLE coloc_test")
