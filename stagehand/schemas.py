"""Raw and staged table schemas.

The raw layer is all strings: typing happens in staging with guarded casts, so a
stray token ("Not Ranked", "N/A", "") can never make a load fail or a type drift.
One registry owns the column lists; sources, staging and checks all read it.
"""
from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Raw column lists of the eight raw tables (names and order must
# match the raw feed exactly).
# ---------------------------------------------------------------------------
RAW_FIELDS: dict[str, list[str]] = {
    "user_info": ["user_id", "yearregistered", "lastlogin", "country",
                  "stateorprovince", "traderating"],
    "item_info": ["objectid", "name", "yearpublished", "minplayers", "maxplayers",
                  "minplaytime", "maxplaytime", "playingtime", "numowned",
                  "average", "bayesaverage", "stddev", "rank"],
    "user_item": ["user_id", "objectid", "user_rating", "numplays", "comment",
                  "own", "prevowned", "fortrade", "want", "wanttoplay", "wanttobuy",
                  "wishlist", "wishlistpriority", "preordered", "lastmodified"],
    "item_details": ["objectid", "name", "yearpublished", "minage", "description",
                     "avg_weights"],
    "item_stats": ["objectid", "usersrated", "average", "bayesaverage", "stddev",
                   "owned", "trading", "wanting", "wishing", "numcomments",
                   "numweights", "averageweight"],
    "item_link": ["objectid", "link_type", "ref_id", "value"],
    "item_rank": ["objectid", "rank_type", "friendlyname", "value", "bayesaverage"],
    "user_play": ["play_id", "user_id", "objectid", "play_date", "quantity", "length",
                  "incomplete", "location"],
}

# Status flags carried on a collection item.
STATUS_FLAG_KEYS = ["own", "prevowned", "fortrade", "want", "wanttoplay", "wanttobuy",
                    "wishlist", "wishlistpriority", "preordered", "lastmodified"]

# Work-list tables of the ingest ledger.
WORK_FIELDS: dict[str, list[str]] = {
    "user_list": ["user_id"],
    "sample_users": ["user_id"],
    "excluded_users": ["user_id", "reason"],
}


def raw_schema(table: str) -> T.StructType:
    """All-string schema of a raw table; unknown names are an error, never a guess."""
    fields = RAW_FIELDS.get(table) or WORK_FIELDS.get(table)
    if fields is None:
        raise ValueError(f"unknown raw table: {table!r}; known: {sorted(RAW_FIELDS)}")
    return T.StructType([T.StructField(c, T.StringType(), True) for c in fields])


# Staged types per raw column. Kinds: str, int, double, date, datetime, flag,
# rank (int with the "Not Ranked" token nulled), rating (double with "N/A" nulled).
STAGED_KINDS: dict[str, dict[str, str]] = {
    "user_info": {"user_id": "str", "yearregistered": "int", "lastlogin": "date",
                  "country": "str", "stateorprovince": "str", "traderating": "int"},
    "item_info": {"objectid": "str", "name": "str", "yearpublished": "int",
                  "minplayers": "int", "maxplayers": "int", "minplaytime": "int",
                  "maxplaytime": "int", "playingtime": "int", "numowned": "int",
                  "average": "double", "bayesaverage": "double", "stddev": "double",
                  "rank": "rank"},
    "user_item": {"user_id": "str", "objectid": "str", "user_rating": "rating",
                  "numplays": "int", "comment": "str", "own": "flag", "prevowned": "flag",
                  "fortrade": "flag", "want": "flag", "wanttoplay": "flag",
                  "wanttobuy": "flag", "wishlist": "flag", "wishlistpriority": "int_nb",
                  "preordered": "flag", "lastmodified": "datetime"},
    "item_details": {"objectid": "str", "name": "str", "yearpublished": "int",
                     "minage": "int", "description": "str", "avg_weights": "double"},
    "item_stats": {"objectid": "str", "usersrated": "int", "average": "double",
                   "bayesaverage": "double", "stddev": "double", "owned": "int",
                   "trading": "int", "wanting": "int", "wishing": "int",
                   "numcomments": "int", "numweights": "int", "averageweight": "double"},
    "item_link": {"objectid": "str", "link_type": "str", "ref_id": "int", "value": "str"},
    "item_rank": {"objectid": "str", "rank_type": "str", "friendlyname": "str",
                  "value": "rank", "bayesaverage": "double"},
    "user_play": {"play_id": "str", "user_id": "str", "objectid": "str",
                  "play_date": "date", "quantity": "int", "length": "int",
                  "incomplete": "flag", "location": "str"},
}
