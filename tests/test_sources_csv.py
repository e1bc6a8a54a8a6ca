"""All-string CSV raw layer: quoting, multi-line comments, blanks, null tokens, loads."""
import pytest
from pyspark.sql import functions as F

from stagehand.sources import raw_csv
from stagehand.schemas import RAW_FIELDS


def test_csv_roundtrip_multiline_quotes(spark, tmp_dir):
    rows = [("u1", "10", "7", "2", 'said "hi"\nand left, twice', "1"),
            ("u2", "11", "N/A", "0", "", ""),
            ("u3", "001", None, None, None, None)]
    df = spark.createDataFrame(rows, "user_id string, objectid string, user_rating string, numplays string,"
                                     " comment string, own string")
    raw_csv.write_csv(df, tmp_dir + "/ui")
    back = raw_csv.read_csv_strings(spark, tmp_dir + "/ui", df.columns)
    got = {r.user_id: r for r in back.collect()}
    assert got["u1"].comment == 'said "hi"\nand left, twice'
    assert got["u3"].objectid == "001"                      # never typed on the way in
    assert got["u3"].comment is None and got["u2"].user_rating == "N/A"


def test_null_tokens_only_on_chosen_columns(spark):
    df = spark.createDataFrame([("None", "N/A", "NA")], "user_id string, user_rating string, comment string")
    r = raw_csv.apply_null_tokens(df, ["user_rating"]).first()
    assert r.user_id == "None" and r.user_rating is None and r.comment == "NA"


def test_load_raw_counts_and_unknown_table(spark, tmp_dir):
    header = ",".join(RAW_FIELDS["item_link"])
    with open(tmp_dir + "/links.csv", "w") as f:
        f.write(header + "\n10,boardgamecategory,771,Heist\n10,boardgamemechanic,2001,\"Dice, Rolling\"\n")
    n = raw_csv.load_raw(spark, "item_link", tmp_dir + "/links.csv", tmp_dir + "/out")
    assert n == 2
    assert spark.read.parquet(tmp_dir + "/out").where(F.col("value") == "Dice, Rolling").count() == 1
    assert raw_csv.load_raw(spark, "item_link", tmp_dir + "/links.csv", tmp_dir + "/out") == 2   # idempotent
    assert spark.read.parquet(tmp_dir + "/out").count() == 2
    with pytest.raises(ValueError):
        raw_csv.read_raw(spark, "nope", tmp_dir + "/links.csv")


def test_ensure_database(spark):
    raw_csv.ensure_database(spark, "stagehand_raw_test")
    raw_csv.ensure_database(spark, "stagehand_raw_test")
    assert "stagehand_raw_test" in [d.name for d in spark.catalog.listDatabases()]


def test_columns_are_bound_by_name_and_rows_must_fit(spark, tmp_dir):
    import pytest
    from stagehand.sources import raw_csv

    def put(name, text):
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.write(text)
        return f"{tmp_dir}/{name}"

    cols = ["a", "b", "c"]
    got = raw_csv.read_csv_strings(spark, put("x.csv", "c,extra,a,b\n3,x, 1 ,2\n"), cols).collect()
    assert [tuple(r) for r in got] == [(" 1 ", "2", "3")]
    with pytest.raises(ValueError, match="no column b"):
        raw_csv.read_csv_strings(spark, put("y.csv", "a,c\n1,3\n"), cols)
    ragged = put("z.csv", "a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        raw_csv.read_csv_strings(spark, ragged, cols).collect()
    kept = raw_csv.read_csv_strings(spark, ragged, cols, ragged="keep").collect()
    assert [tuple(r) for r in kept] == [("1", "2", "3"), ("4", "5", None), ("6", "7", "8")]


def test_edge_spaces_survive_a_round_trip(spark, tmp_dir):
    from stagehand.sources import raw_csv
    rows = [("  lead",), ("trail  ",), (' "quoted", \n line ',), ("\ttab",)]
    raw_csv.write_csv(spark.createDataFrame(rows, "t string"), f"{tmp_dir}/s")
    assert sorted(tuple(r) for r in raw_csv.read_csv_strings(spark, f"{tmp_dir}/s", ["t"]).collect()) == sorted(rows)
