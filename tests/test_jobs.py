"""The batch jobs end to end on small hand-made exports: legacy load → stage → check,
and the per-table CSV load, through the functions and the command line."""
import csv
import os

from pyspark.sql import functions as F

from stagehand import jobs


def _csv(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def _legacy_export(d):
    os.makedirs(d)
    # extra columns (names, avatars) are dropped
    _csv(f"{d}/user_info.csv", ["user_id", "firstname", "yearregistered", "lastlogin", "country", "stateorprovince", "traderating"],
         [["u1", "Ann", "2011", "2021-03-09", "Chile", "", "0"], ["u2", "Bo", "2019", "", "", "", "1"]])
    _csv(f"{d}/item_info.csv", ["objectid", "name", "yearpublished", "numowned", "average", "rank", "thumbnail", "minplayers", "maxplayers", "minplaytime",
                                  "maxplaytime", "playingtime", "bayesaverage", "stddev"],
         [["1", "Alpha", "1995", "100", "7.1", "Not Ranked", "t.png", *[""] * 7], ["2", "Beta", "2015", "50", "abc", "12", "", *[""] * 7]])
    _csv(f"{d}/user_item.csv", ["user_id", "objectid", "user_rating", "numplays", "comment"],
         [["u1", "1", "8", "2", 'said "hi"\nthen left'], ["u1", "1", "", "0", ""], ["u2", "9", "11", "1", ""]])
    _csv(f"{d}/item_details.csv", ["objectid", "name", "minage", "description", "avg_weights", "category",
                                    "mechanic", "publisher"],
         [["1", "Alpha", "8", "two\nlines", "2.5", "[('771', 'Heist')]",
           "[('2001', \"Dice, and more\"), ('2002', 'Cards')]", "[]"],
          ["2", "Beta", "10", "d", "7", "", "[('2001', 'Dice')", "[('3', 'Pub')]"]])


def test_legacy_load_stage_and_check(spark, tmp_dir):
    src, raw, stg, out = (f"{tmp_dir}/{p}" for p in ("legacy", "raw", "stg", "out"))
    _legacy_export(src)
    counts = jobs.load_legacy(spark, src, raw)
    # item 2's mechanic cell is malformed (no closing bracket): no rows, never invented ones
    assert counts == {"user_info": 2, "item_info": 2, "user_item": 3, "item_details": 2, "item_link": 4}
    ui = {r.user_id: r for r in spark.read.parquet(f"{raw}/user_info").collect()}
    assert ui["u1"].country == "Chile" and ui["u2"].lastlogin is None and ui["u1"].stateorprovince is None
    own = {r.own for r in spark.read.parquet(f"{raw}/user_item").collect()}
    assert own == {"1"}
    links = sorted((r.objectid, r.link_type, r.ref_id, r.value) for r in spark.read.parquet(f"{raw}/item_link").collect())
    assert ("1", "boardgamemechanic", "2001", "Dice, and more") in links
    assert ("2", "boardgamepublisher", "3", "Pub") in links

    staged = jobs.stage_layer(spark, raw, stg)
    assert staged == {"stg_user_info": 2, "stg_item_info": 2, "stg_item_details": 2, "stg_user_item": 3,
                      "stg_item_link": 4}
    layer = jobs.read_staging(spark, stg)
    info = {r.objectid: r for r in layer["stg_item_info"].collect()}
    assert info["1"].rank is None and info["2"].rank == 12 and info["2"].average is None
    det = {r.objectid: r.yearpublished for r in layer["stg_item_details"].collect()}
    assert det == {"1": 1995, "2": 2015}                   # year taken from item_info (left join)
    ratings = sorted((r.user_rating is None, r.user_rating) for r in layer["stg_user_item"].collect())
    assert ratings[-1] == (True, None)                      # blank rating stays NULL, never 0
    assert {r.mechanic for r in layer["item_mechanic"].collect()} == {"Dice, and more", "Cards"}

    rows = {r["check_id"]: r for r in jobs.check_layer(spark, raw, out)}
    assert rows["2-1"]["value"] == 1.0 and rows["2-1"]["passed"] is False   # item 9 unknown
    assert rows["1-3"]["value"] == 1.0                                        # (u1, 1) twice
    hist = spark.read.parquet(f"{out}/reports/user_rating_out_of_range").collect()
    assert [(r.user_rating, r.n) for r in hist] == [("11", 1)]


def test_raw_csv_load_and_command_line(spark, tmp_dir, capsys):
    csv_dir, raw, stg = f"{tmp_dir}/csv", f"{tmp_dir}/raw", f"{tmp_dir}/stg"
    os.makedirs(csv_dir)
    _csv(f"{csv_dir}/user_info.csv", ["user_id", "yearregistered", "lastlogin", "country", "stateorprovince",
                                      "traderating"], [["u1", "2011", "2021-03-09", "N/A", "", "0"]])
    _csv(f"{csv_dir}/user_item.csv", ["user_id", "objectid", "user_rating", "numplays", "comment", "own",
                                      "prevowned", "fortrade", "want", "wanttoplay", "wanttobuy", "wishlist",
                                      "wishlistpriority", "preordered", "lastmodified"],
         [["u1", "1", "N/A", "0", "None", "1", "0", "0", "0", "0", "0", "1", "3", "0", "2020-02-11 08:15:44"]])
    jobs.main(["load-raw", csv_dir, raw, "--null-token-columns", "user_rating"])
    assert capsys.readouterr().out.strip() == '{"user_info": 1, "user_item": 1}'
    r = spark.read.parquet(f"{raw}/user_item").first()
    assert r.user_rating is None and r.comment == "None"    # tokens only where named
    assert spark.read.parquet(f"{raw}/user_info").first().country == "N/A"
    jobs.main(["stage", raw, stg])
    got = spark.read.parquet(f"{stg}/stg_user_item").select("wishlist", F.col("lastmodified").cast("string")).first()
    assert got[0] is True and got[1] == "2020-02-11 08:15:44"


def test_drop_scratch_removes_only_scratch(spark):
    from stagehand import session
    df = session.materialize(spark.range(10), "to-drop")
    path = df.inputFiles()[0].split("/to-drop-")[0]
    local = path.replace("file:", "")
    assert os.path.isdir(local)
    session.drop_scratch(spark)
    assert not os.path.exists(local)
    assert session.materialize(spark.range(3), "after").count() == 3      # scratch is usable again


def test_stream_things_job_resumes(spark, tmp_dir, capsys):
    from test_xml_parsers import things
    land, raw = f"{tmp_dir}/land", f"{tmp_dir}/raw"
    os.makedirs(land)
    for i in (11, 12):
        with open(f"{land}/t{i}.xml", "w") as f:
            f.write(things(str(i)))
    jobs.main(["stream-things", land, raw])
    assert '"done": 2' in capsys.readouterr().out
    with open(f"{land}/t13.xml", "w") as f:
        f.write(things("13"))
    jobs.main(["stream-things", land, raw])
    assert '"done": 3' in capsys.readouterr().out
    assert spark.read.parquet(f"{raw}/item_details").count() == 3


def test_stream_collections_job_lands_first_seen_item_info(spark, tmp_dir, capsys):
    land, raw = f"{tmp_dir}/land", f"{tmp_dir}/raw"
    for user, oid in (("ann", "5"), ("ben", "5"), ("cy", "6")):
        os.makedirs(f"{land}/{user}")
        with open(f"{land}/{user}/p1.xml", "w") as f:
            f.write(f'<items><item objectid="{oid}" subtype="boardgame"><name>N{user}</name>'
                    f'<stats numowned="3"><rating value="7"/></stats><status own="1"/></item></items>')
    jobs.main(["stream-collections", land, raw])
    assert '"done": 3' in capsys.readouterr().out
    assert spark.read.parquet(f"{raw}/user_item").count() == 3
    assert sorted(r.objectid for r in spark.read.parquet(f"{raw}/item_info").collect()) == ["5", "6"]


def test_load_raw_reads_a_folder_of_csv_parts(spark, tmp_dir):
    from stagehand.schemas import raw_schema
    from stagehand.sources import raw_csv
    rows = [("1", "boardgamecategory", "771", 'An "old",\nmulti-line name'), ("2", "boardgamemechanic", "", "Dice")]
    raw_csv.write_csv(spark.createDataFrame(rows, raw_schema("item_link")).repartition(2), f"{tmp_dir}/csv/item_link")
    counts = jobs.load_raw_layer(spark, f"{tmp_dir}/csv", f"{tmp_dir}/raw")
    assert counts == {"item_link": 2}
    got = {r.objectid: (r.ref_id, r.value) for r in spark.read.parquet(f"{tmp_dir}/raw/item_link").collect()}
    assert got == {"1": ("771", 'An "old",\nmulti-line name'), "2": (None, "Dice")}   # blank → NULL


def test_work_list_job_samples_once_and_leaves_out_finished_units(spark, tmp_dir, capsys):
    from test_streaming import put
    from test_xml_parsers import collection, item
    spark.range(1, 41).select(F.concat(F.lit("u"), "id").alias("user_id")).write.parquet(f"{tmp_dir}/users")
    args = ["work-list", f"{tmp_dir}/raw", f"{tmp_dir}/todo", "--candidates", f"{tmp_dir}/users", "--sample", "10"]
    jobs.main(args)
    assert '"sampled": 10, "processed": 0, "excluded": 0, "remaining": 10' in capsys.readouterr().out
    first = sorted(r.user_id for r in spark.read.parquet(f"{tmp_dir}/todo").collect())
    put(f"{tmp_dir}/land/{first[0]}/1.xml", collection(item("1")))
    for k in range(5):                                     # never whole: failed after its retries
        put(f"{tmp_dir}/land/{first[1]}/{k}.xml", "<items><item")
        jobs.main(["stream-collections", f"{tmp_dir}/land", f"{tmp_dir}/raw", "--max-files-per-trigger", "2"])
    assert '"done": 1, "retry": 0, "failed": 1' in capsys.readouterr().out
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_dir}/raw/collections_excluded").collect()] == [(first[1], "exhausted:bad_body")]
    jobs.main(args)
    assert '"sampled": 10, "processed": 1, "excluded": 1, "remaining": 8' in capsys.readouterr().out
    assert sorted(r.user_id for r in spark.read.parquet(f"{tmp_dir}/todo").collect()) == first[2:]
