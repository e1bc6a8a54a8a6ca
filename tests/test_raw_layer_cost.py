"""The raw layer parses and lands only what the tables asked for hold, and plays meet once."""
from conftest import SF_SMALL, plan_text

from stagehand.plans import catalog
from stagehand.schemas import RAW_FIELDS
from stagehand.sources import xml_pages


def test_plays_pages_need_one_exchange(spark):
    pages = catalog._plays_pages(spark, SF_SMALL)
    assert plan_text(pages).count("Exchange hashpartitioning") == 1


def test_raw_layer_lands_the_columns_of_the_tables_asked_for(spark, monkeypatch):
    landed = {}

    def materialize(df, name):
        landed[name] = df.columns
        return df

    monkeypatch.setattr(catalog, "materialize", materialize)
    wanted = {("user_item",): RAW_FIELDS["user_item"], ("item_info",): ["user_id", *RAW_FIELDS["item_info"]],
              ("item_info", "user_item"): ["user_id", *RAW_FIELDS["item_info"], *RAW_FIELDS["user_item"][2:]]}
    for names, columns in wanted.items():
        raw = catalog._raw_layer(spark, SF_SMALL, names)
        assert sorted(landed["pages-collection"]) == sorted(columns) and tuple(raw) == names


def test_item_info_schema_has_no_field_that_its_rows_do_not_read():
    assert "_sortindex" not in xml_pages.COLLECTION_ITEM_INFO_SCHEMA and "_bayesaverage" not in xml_pages.COLLECTION_ITEM_INFO_SCHEMA


def test_checklist_parses_no_item_and_no_field_that_its_tables_do_not_hold(spark, monkeypatch):
    landed = {}
    monkeypatch.setattr(catalog, "materialize", lambda df, name: landed.setdefault(name, df))
    items = catalog._collection_items(spark, SF_SMALL)
    kept = catalog.table(spark, SF_SMALL, "lineitem").where("l_returnflag <> 'R'").count()
    assert items.where("item IS NOT NULL").count() == kept
    raw = catalog._raw_layer(spark, SF_SMALL, ("item_details", "item_link"))
    assert "usersrated" not in landed["pages-things"].schema.simpleString() and tuple(raw) == ("item_details", "item_link")
    raw = catalog._raw_layer(spark, SF_SMALL, ("item_info", "user_item"))
    assert "_sortindex" not in plan_text(landed["pages-collection"])
