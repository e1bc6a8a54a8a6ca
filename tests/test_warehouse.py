"""Staging layer and raw-layer checklist on a hand-made raw layer with the edge cases
a crawl produces (FIXTURES.md): N/A, Not Ranked, blanks, decimal in an integer
column, partial dates, repeated (user, item), orphan item, item without details."""
import pytest

from stagehand.plans import warehouse
from stagehand.schemas import raw_schema


@pytest.fixture()
def raw(spark):
    t = lambda name, rows: spark.createDataFrame(rows, raw_schema(name))
    return {
        "user_info": t("user_info", [("u1", "2014", "2017-12-20", "RO", None, "0"),
                                     ("u2", "2019", "2020-05", None, None, "1"),
                                     ("u2", "2019", "2020-05-01", "DE", "BY", "x")]),
        "item_info": t("item_info", [("1", "A", "1500", "2", "4", "30", "60", "60", "100", "7.1", "6.2", "1.1", "Not Ranked"),
                                     ("2", "B", "2015", "1", "2.5", "", "", "", "50", "abc", "", "", "12"),
                                     ("3", "C", "", "", "", "", "", "", "", "", "", "", "")]),
        "user_item": t("user_item", [("u1", "1", "N/A", "0", None, "1", "0", "0", "0", "0", "0", "1", "3", "0",
                                      "2020-02-11 08:15:44"),
                                     ("u1", "1", "8", "2", 'said "hi"\nbye', "1", "", "", "", "", "", "", "", "", None),
                                     ("u2", "9", "11", "1", None, "1", "", "", "", "", "", "", "", "", None)]),
        "item_details": t("item_details", [("1", "A", None, "8", "d", "2.5"), ("2", "B", "2015", "x", "d", "7")]),
        "item_link": t("item_link", [("1", "boardgamecategory", "771", "Heist"),
                                     ("1", "boardgamemechanic", "x1", "Dice"),
                                     ("4", "boardgamepublisher", "3", "P")]),
    }


def test_checklist(raw):
    got = {r.check_id: (r.value, r.passed) for r in warehouse.quality_checklist(raw).collect()}
    assert got["1-1"] == (1.0, False)                      # u2 twice
    assert got["1-2"] == (0.0, True)
    assert got["1-3"] == (1.0, None)                       # (u1, 1) repeats: information only
    assert got["2-1"] == (1.0, False)                      # item 9 unknown
    assert got["2-2"] == (1.0, False)                      # link of item 4
    assert got["2-3:in_details_not_info"][0] == 0.0 and got["2-3:in_info_not_details"][0] == 1.0
    assert got["3-4/4-2:average_cast_fail"] == (1.0, False)
    assert got["3-4/4-2:rank_cast_fail"] == (0.0, True)    # 'Not Ranked' is allowed
    assert got["3-4/4-2:rank_not_ranked_rate"][0] == 0.3333
    assert got["3-4/4-2:yearpublished_out_of_range"][0] == 2.0   # 1500 and blank
    assert got["3-1/4-3/5:user_rating_out_of_range"] == (1.0, False)   # '11'; 'N/A' exempt
    assert got["3-2:avg_weights_out_of_range"] == (1.0, False)
    assert got["4-1:country_blank_rate"][0] == 0.3333
    assert got["6-1"] == (1.0, False)                      # item 2 has details but no link
    assert got["6-2"] == (1.0, False)                      # ref_id 'x1'


def test_staging_layer(raw):
    stg = warehouse.staging_layer(raw)
    items = {r.objectid: r for r in stg["stg_item_info"].collect()}
    assert items["1"].rank is None and items["2"].rank == 12 and items["2"].maxplayers is None  # '2.5' not an int
    users = {(r.user_id, r.traderating): r for r in stg["stg_user_info"].collect()}
    assert users[("u2", 1)].lastlogin is None                 # partial date
    det = {r.objectid: r for r in stg["stg_item_details"].collect()}
    assert det["1"].yearpublished == 1500 and det["2"].minage is None
    ui = stg["stg_user_item"].collect()
    assert sorted(str(r.user_rating) for r in ui) == ["11.0", "8.0", "None"]
    assert [r.category for r in stg["item_category"].collect()] == ["Heist"]
    assert stg["item_mechanic"].first().mechanic_id is None
    reports = warehouse.checklist_reports(raw)
    assert [tuple(r) for r in reports["user_rating_out_of_range"].collect()] == [("11", 1)]
    assert reports["duplicate_user_ids"].first().user_id == "u2"
