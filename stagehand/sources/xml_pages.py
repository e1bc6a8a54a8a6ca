"""XML API pages → raw rows (S9–S12), with Spark's built-in XML support.

Every parser takes a DataFrame with one XML document per row (``from_xml``) or
reads files with ``rowTag`` — always with an explicit all-string schema, so an
id like "001" stays "001" and a missing node is NULL, never a guessed type.
Nested repeated elements (names, links, ranks, plays) are arrays of structs and
are flattened to long rows with ``explode``/``inline``. Parsers emit '' for a
missing field, like the collectors did; ``blanks_to_null`` gives the raw form.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW_FIELDS, STATUS_FLAG_KEYS

# Parser options: text and attribute values are kept exactly as sent — Spark's
# default trims surrounding whitespace of both, a plain DOM read does not — and
# a malformed document gives an all-NULL row instead of failing the job.
XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}

_V = "struct<_value:string>"

USER_SCHEMA = ("_id string, _name string, yearregistered {v}, lastlogin {v}, country {v}, "
               "stateorprovince {v}, traderating {v}").format(v=_V)

_RATING_TAGS = ["usersrated", "average", "bayesaverage", "stddev", "median", "owned", "trading",
                "wanting", "wishing", "numcomments", "numweights", "averageweight"]
_RANK = "struct<_type:string,_id:string,_name:string,_friendlyname:string,_value:string,_bayesaverage:string>"
THING_SCHEMA = (
    "_id string, _type string, "
    "name array<struct<_type:string,_sortindex:string,_value:string>>, description string, "
    f"yearpublished {_V}, minplayers {_V}, maxplayers {_V}, playingtime {_V}, "
    f"minplaytime {_V}, maxplaytime {_V}, minage {_V}, "
    "link array<struct<_type:string,_id:string,_value:string>>, "
    "statistics struct<ratings:struct<"
    + ", ".join(f"{t}:{_V}" for t in _RATING_TAGS)
    + f", ranks:struct<rank:array<{_RANK}>>>>"
)

# Narrow thing schemas: the fields one output reads (Spark does not prune them itself).
THING_LINK_SCHEMA = "_id string, link array<struct<_type:string,_id:string,_value:string>>"
THING_RANK_SCHEMA = f"_id string, statistics struct<ratings:struct<ranks:struct<rank:array<{_RANK}>>>>"
THING_DETAILS_LINK_SCHEMA = (
    f"_id string, name array<struct<_value:string>>, description string, yearpublished {_V}, minage {_V}, "
    f"link array<struct<_type:string,_id:string,_value:string>>, statistics struct<ratings:struct<averageweight:{_V}>>"
)

_STAT_ATTRS = ["minplayers", "maxplayers", "minplaytime", "maxplaytime", "playingtime", "numowned"]
COLLECTION_ITEM_SCHEMA = (
    "_objectid string, _subtype string, name struct<_VALUE:string,_sortindex:string>, "
    "yearpublished string, numplays string, comment string, "
    "stats struct<" + ", ".join(f"_{a}:string" for a in _STAT_ATTRS)
    + f", rating:struct<_value:string, average:{_V}, bayesaverage:{_V}, stddev:{_V}, "
    f"ranks:struct<rank:array<{_RANK}>>>>, "
    "status struct<" + ", ".join(f"_{k}:string" for k in STATUS_FLAG_KEYS) + ">"
)

# The fields the item_info rows read (no status flags, comment, plays or own rating; of a
# name its text, of a rank its friendlyname and value): a quarter of the parse is the rest.
_INFO_RANKS = "ranks:struct<rank:array<struct<_friendlyname:string,_value:string>>>"
COLLECTION_ITEM_INFO_SCHEMA = (
    "_objectid string, _subtype string, name struct<_VALUE:string>, yearpublished string, "
    "stats struct<" + ", ".join(f"_{a}:string" for a in _STAT_ATTRS)
    + f", rating:struct<average:{_V}, bayesaverage:{_V}, stddev:{_V}, {_INFO_RANKS}>>"
)

# The fields that item_info and user_item rows read together.
COLLECTION_ROW_SCHEMA = (
    "_objectid string, _subtype string, name struct<_VALUE:string>, yearpublished string, numplays string, comment string, "
    "stats struct<" + ", ".join(f"_{a}:string" for a in _STAT_ATTRS)
    + f", rating:struct<_value:string, average:{_V}, bayesaverage:{_V}, stddev:{_V}, {_INFO_RANKS}>>, "
    "status struct<" + ", ".join(f"_{k}:string" for k in STATUS_FLAG_KEYS) + ">"
)

# The fields the user_item rows read: parsing only these is about a third cheaper.
COLLECTION_USER_ITEM_SCHEMA = (
    "_objectid string, _subtype string, numplays string, comment string, "
    "stats struct<rating:struct<_value:string>>, "
    "status struct<" + ", ".join(f"_{k}:string" for k in STATUS_FLAG_KEYS) + ">"
)

# The fields the user_play and page rows read.
PLAYS_PAGE_SCHEMA = (
    "_username string, _total string, _page string, "
    "play array<struct<_id:string,_date:string,_quantity:string,_length:string,"
    "_incomplete:string,_location:string,item:struct<_objectid:string>>>"
)

# What page completeness reads: page attributes and how many plays a page holds.
PLAYS_PAGE_COUNT_SCHEMA = "_total string, _page string, play array<struct<_id:string>>"


def _dflt(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def _explode_parsed(df: DataFrame, keep: list, arr: Column, name: str) -> DataFrame:
    """One row per element of a parsed array.

    ``explode`` would make the optimizer infer ``size(arr) > 0`` and push it below
    the parse, running ``from_xml`` twice per row; ``explode_outer`` plus a filter
    on the generated column (which cannot move below the generator) parses once.
    """
    return df.select(*keep, F.explode_outer(arr).alias(name)).where(F.col(name).isNotNull())


def xml_escape(c: Column) -> Column:
    """Escape text for an XML attribute or element (used when rendering pages)."""
    s = F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;"))
    s = F.replace(s, F.lit("<"), F.lit("&lt;"))
    s = F.replace(s, F.lit(">"), F.lit("&gt;"))
    return F.replace(s, F.lit('"'), F.lit("&quot;"))


# --- S9 user pages -----------------------------------------------------------------

def parse_user_pages(df: DataFrame, xml_col: str, user_id_col: str) -> DataFrame:
    """One user page per row → raw user_info rows."""
    u = F.from_xml(F.col(xml_col), USER_SCHEMA, XML_OPTIONS).alias("u")
    return user_rows(df.select(F.col(user_id_col).cast("string").alias("user_id"), u), "u")


def user_rows(parsed: DataFrame, user_col: str = "user", keep: Sequence[str] = ()) -> DataFrame:
    """Parsed user pages (struct column ``user_col`` + ``user_id``) → raw user_info rows.

    The id is the one the page was requested with (``user_id``), as the crawl
    recorded it, not an attribute of the page.
    """
    return parsed.select("user_id", *[_dflt(F.col(f"{user_col}.{c}._value")).alias(c)
                                      for c in RAW_FIELDS["user_info"][1:]], *keep)


# --- S10 thing items -----------------------------------------------------------------

def parse_thing_items(items: DataFrame, item_col: str = "item",
                      keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parsed thing items → (details, stats, links, ranks) raw rows.

    ``items`` has a struct column shaped by ``THING_SCHEMA``. One scan feeds four
    projections, with the ``keep`` columns last. ``name`` is the first name element
    (primary by position); ``avg_weights`` repeats ``averageweight``.
    """
    return (thing_details(items, item_col, keep), thing_stats(items, item_col, keep),
            thing_links(items, item_col, keep), thing_ranks(items, item_col, keep))


def _oid(it: Column) -> Column:
    return _dflt(it["_id"]).alias("objectid")


def thing_details(items: DataFrame, item_col: str = "item", keep: Sequence[str] = ()) -> DataFrame:
    it = F.col(item_col)
    return items.select(
        _oid(it), _dflt(F.get(it["name"], 0)["_value"]).alias("name"),
        _dflt(it["yearpublished"]["_value"]).alias("yearpublished"),
        _dflt(it["minage"]["_value"]).alias("minage"),
        _dflt(it["description"]).alias("description"),
        _dflt(it["statistics"]["ratings"]["averageweight"]["_value"]).alias("avg_weights"), *keep)


def thing_stats(items: DataFrame, item_col: str = "item", keep: Sequence[str] = ()) -> DataFrame:
    it = F.col(item_col)
    r = it["statistics"]["ratings"]
    return items.select(_oid(it), *[_dflt(r[t]["_value"]).alias(t) for t in RAW_FIELDS["item_stats"][1:]], *keep)


def thing_links(items: DataFrame, item_col: str = "item", keep: Sequence[str] = ()) -> DataFrame:
    """Repeated ``link`` elements → long item_link rows (works on ``THING_LINK_SCHEMA``)."""
    it = F.col(item_col)
    return _explode_parsed(items.select(_oid(it), it["link"].alias("_l"), *keep), ["objectid", *keep], F.col("_l"), "l").select(
        "objectid", _dflt(F.col("l._type")).alias("link_type"),
        _dflt(F.col("l._id")).alias("ref_id"), _dflt(F.col("l._value")).alias("value"), *keep)


def thing_ranks(items: DataFrame, item_col: str = "item", keep: Sequence[str] = ()) -> DataFrame:
    """Nested ``rank`` elements → long item_rank rows (works on ``THING_RANK_SCHEMA``)."""
    it = F.col(item_col)
    k = it["statistics"]["ratings"]["ranks"]["rank"]
    return _explode_parsed(items.select(_oid(it), k.alias("_k"), *keep), ["objectid", *keep], F.col("_k"), "k").select(
        "objectid", _dflt(F.col("k._type")).alias("rank_type"),
        _dflt(F.col("k._friendlyname")).alias("friendlyname"),
        _dflt(F.col("k._value")).alias("value"), _dflt(F.col("k._bayesaverage")).alias("bayesaverage"), *keep)


def thing_items_from_strings(df: DataFrame, xml_col: str, schema: str = THING_SCHEMA) -> DataFrame:
    """One ``<item>`` document per row → struct column ``item``; a narrower
    schema (``THING_LINK_SCHEMA``, ``THING_RANK_SCHEMA``) parses only what one
    output reads."""
    return df.select(F.from_xml(F.col(xml_col), schema, XML_OPTIONS).alias("item"))


# --- whole responses --------------------------------------------------------------------

BAD_COL = "_bad"
_PROLOG = r"\A\s*+(?:<\?[^>]*+>\s*+|<!--(?:(?!-->)[\s\S])*+-->\s*+|<![A-Za-z][^>]*+>\s*+)*+"


def parse_responses(df: DataFrame, body_col: str, root: str, schema: str, as_col: str = "pg") -> DataFrame:
    """One whole response per row → its columns, struct ``as_col`` and ``body_ok``.

    A body is good if it is well-formed XML with the root element ``root``: a cut
    page, an error page, plain text and a missing body are not, and must go to
    the ledger instead of becoming blank rows. An empty collection is good.
    """
    options = {**XML_OPTIONS, "columnNameOfCorruptRecord": BAD_COL}
    parsed = F.from_xml(F.col(body_col), f"{schema}, {BAD_COL} string", options)
    ok = (F.col(body_col).rlike(rf"{_PROLOG}<{root}[\s/>]") & F.col(f"{as_col}.{BAD_COL}").isNull())
    return df.select("*", parsed.alias(as_col)).withColumn("body_ok", F.coalesce(ok, F.lit(False)))


def items_schema(item_schema: str) -> str:
    """Schema of an ``<items>`` response holding ``<item>`` elements of the given schema."""
    fields = re.sub(r"(^|, )(\w+) (?=string|array<|struct<)", r"\1\2:", item_schema)
    return f"_totalitems string, item array<struct<{fields}>>"


def response_items(good: DataFrame, keep: list[str], page_col: str = "pg", as_col: str = "item") -> DataFrame:
    """Good ``<items>`` responses → one row per ``<item>``; an empty response gives none."""
    return _explode_parsed(good, keep, F.col(page_col)["item"], as_col)


def url_decoded(c: Column) -> Column:
    """``c`` without its %XX escapes, ``+`` kept; as it is if they are none."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def unit_of_path(path: Column, unit_dir: bool) -> Column:
    """The unit of work that a response file belongs to, from its decoded path: the
    file's name without its extension, or with ``unit_dir`` the name of its folder,
    as the unit is called (blanks, ``%``, ``+``, ``=`` and other letters included).
    A folder ``unit=<id>`` is one that Spark's partitioned writer made: its escapes are undone."""
    if not unit_dir:
        return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?\z", 1)
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+\z", 1)
    return F.when(F.startswith(folder, F.lit("unit=")), url_decoded(F.substring(folder, 6, 2**31 - 1))).otherwise(folder)


# --- response files ---------------------------------------------------------------------

def read_page_files(spark: SparkSession, path: str, row_tag: str, schema: str, as_col: str,
                    unit_dir: bool = False) -> DataFrame:
    """Landed API response files → one row per ``row_tag`` element, as struct ``as_col``.

    Each file is one response with its root element (``<items>``, ``<plays>``,
    ``<user>``), as the API sends it; the XML source splits large files across
    tasks by element. With ``unit_dir`` the files sit in one folder per unit of
    work (``<path>/<unit id>/<page>.xml``) and the folder name becomes
    ``user_id`` — for responses that do not name their user (collections).
    """
    r = spark.read.format("xml").options(**XML_OPTIONS).option("rowTag", row_tag).schema(schema)
    if unit_dir:
        r = r.option("recursiveFileLookup", "true")       # unit folders are not key=value partitions
    raw = r.load(path)
    cols = [F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias(as_col)]
    if unit_dir:
        cols.insert(0, unit_of_path(url_decoded(F.col("_metadata.file_path")), True).alias("user_id"))
    return raw.select(*cols)


def read_thing_files(spark: SparkSession, path: str) -> DataFrame:
    """Thing response files (``<items><item>…``) → struct column ``item`` (rowTag=item)."""
    return read_page_files(spark, path, "item", THING_SCHEMA, "item")


def read_user_files(spark: SparkSession, path: str) -> DataFrame:
    """User response files (``<user name=…>``) → raw user_info rows; the id is the
    requested name, which the page carries as its ``name`` attribute."""
    p = read_page_files(spark, path, "user", USER_SCHEMA, "u")
    return user_rows(p.select(F.col("u._name").alias("user_id"), "u"), "u")


def read_collection_files(spark: SparkSession, path: str) -> DataFrame:
    """Collection response files, one folder per user → (user_id, struct ``item``)."""
    return read_page_files(spark, path, "item", COLLECTION_ITEM_SCHEMA, "item", unit_dir=True)


def read_plays_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Plays response files (one page each, ``<plays username=… total=… page=…>``) →
    (user_play rows, per-page rows); the user is the page's ``username``."""
    p = read_page_files(spark, path, "plays", PLAYS_PAGE_SCHEMA, "pg")
    return plays_rows(p.select(F.col("pg._username").alias("user_id"), "pg"), "pg")


# --- S11 collection items ---------------------------------------------------------------

def _kept_items(items: DataFrame, item_col: str, subtype: str | None) -> DataFrame:
    """Only ``subtype`` items (P6), kept or dropped through a generator, not a
    Filter: a Filter would be pushed below the parse and evaluate from_xml a
    second time per row."""
    if subtype is None:
        return items
    it = F.col(item_col)
    others = [c for c in items.columns if c != item_col]
    return _explode_parsed(items, others, F.filter(F.array(it), lambda x: x["_subtype"] == F.lit(subtype)),
                           item_col)


def _user_item_cols(it: Column) -> list[Column]:
    """The user_item fields after ``user_id`` and ``objectid``; ``numplays`` defaults to "0"."""
    return [_dflt(it["stats"]["rating"]["_value"]).alias("user_rating"),
            F.coalesce(F.nullif(it["numplays"], F.lit("")), F.lit("0")).alias("numplays"),
            _dflt(it["comment"]).alias("comment"),
            *[_dflt(it["status"][f"_{k}"]).alias(k) for k in STATUS_FLAG_KEYS]]


def _item_info_cols(it: Column) -> list[Column]:
    """The item_info fields after ``objectid``; ``rank`` is the first rank with a friendlyname."""
    st = it["stats"]
    rating = st["rating"]
    first_rank = F.get(F.filter(rating["ranks"]["rank"], lambda k: k["_friendlyname"].isNotNull()), 0)
    return [_dflt(it["name"]["_VALUE"]).alias("name"), _dflt(it["yearpublished"]).alias("yearpublished"),
            *[_dflt(st[f"_{a}"]).alias(a) for a in _STAT_ATTRS],
            _dflt(rating["average"]["_value"]).alias("average"),
            _dflt(rating["bayesaverage"]["_value"]).alias("bayesaverage"),
            _dflt(rating["stddev"]["_value"]).alias("stddev"),
            _dflt(first_rank["_value"]).alias("rank")]


def flatten_collection_items(items: DataFrame, user_id_col: str, item_col: str = "item",
                             subtype: str | None = "boardgame") -> DataFrame:
    """Parsed collection items → one flat row per kept item (S11 + P6):
    ``user_id`` + the item_info fields + the user_item fields.

    Only ``subtype`` items are kept. ``rank`` is the first rank carrying a
    friendlyname attribute; ``numplays`` defaults to "0". One projection feeds
    both raw tables, so a landing job writes this once.
    """
    it = F.col(item_col)
    return _kept_items(items, item_col, subtype).select(
        F.col(user_id_col).cast("string").alias("user_id"), _dflt(it["_objectid"]).alias("objectid"),
        *_item_info_cols(it), *_user_item_cols(it))


def flat_collection_responses(parsed: DataFrame, keep: list[str], page_col: str = "pg") -> DataFrame:
    """Parsed collection responses → one flat row per item, of any subtype: ``keep``,
    ``_subtype``, ``objectid``, the item_info and the user_item fields. A response that is
    bad or has no items gives one row without a subtype."""
    rows = parsed.select(*keep, F.explode_outer(F.when(F.col("body_ok"), F.col(page_col)["item"])).alias("item"))
    it = F.col("item")
    return rows.select(*keep, it["_subtype"].alias("_subtype"), _dflt(it["_objectid"]).alias("objectid"),
                       *_item_info_cols(it), *_user_item_cols(it))


def collection_item_info_rows(items: DataFrame, user_id_col: str | None = None, item_col: str = "item",
                              subtype: str | None = "boardgame", keep: Sequence[str] = ()) -> DataFrame:
    """Parsed collection items → raw item_info rows only (S11 + P6), with
    ``user_id`` first when ``user_id_col`` is given and the ``keep`` columns
    last (for a first-seen pick). Works on items parsed with
    ``COLLECTION_ITEM_INFO_SCHEMA`` (or the full one)."""
    it = F.col(item_col)
    unit = [F.col(user_id_col).cast("string").alias("user_id")] if user_id_col else []
    return _kept_items(items, item_col, subtype).select(
        *unit, _dflt(it["_objectid"]).alias("objectid"), *_item_info_cols(it), *keep)


def collection_user_item_rows(items: DataFrame, user_id_col: str, item_col: str = "item",
                              subtype: str | None = "boardgame", keep: Sequence[str] = ()) -> DataFrame:
    """Parsed collection items → raw user_item rows only (S11 + P6). Works on
    items parsed with ``COLLECTION_USER_ITEM_SCHEMA`` (or the full schema)."""
    it = F.col(item_col)
    return _kept_items(items, item_col, subtype).select(
        F.col(user_id_col).cast("string").alias("user_id"), _dflt(it["_objectid"]).alias("objectid"),
        *_user_item_cols(it), *keep)


def split_collection_rows(flat: DataFrame, keep_unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """Flat collection rows → (item_info, user_item) raw rows. With ``keep_unit``
    the item rows also carry ``user_id``, so a first-seen rule can pick one per item."""
    item_info = flat.select(*(["user_id"] if keep_unit else []), *RAW_FIELDS["item_info"])
    return item_info, flat.select(*RAW_FIELDS["user_item"])


def parse_collection_items(items: DataFrame, user_id_col: str, item_col: str = "item",
                           subtype: str | None = "boardgame",
                           keep_unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parsed collection items → (item_info, user_item) raw rows (S11 + P6)."""
    return split_collection_rows(flatten_collection_items(items, user_id_col, item_col, subtype), keep_unit)


def _of_other_subtype(xml: Column, subtype: str) -> Column:
    """Whether the item's start tag says plainly that it is of another subtype. Only a tag
    that can be read in one way counts (lower-case names, double quotes, no references,
    one ``subtype``): any other item is left to the parse. However the text goes on, the
    parse of such an item gives that other subtype, or none if it is malformed."""
    attr = r'\s++(?!subtype=)[a-z]++="[^"<&]*+"'
    return xml.rlike(rf'\A<item(?:{attr})*+\s++subtype="(?!\Q{subtype}\E")[a-z]++"(?:{attr})*+\s*+/?>')


def collection_items_from_strings(df: DataFrame, xml_col: str, keep: list[str],
                                  schema: str = COLLECTION_ITEM_SCHEMA, subtype: str | None = None) -> DataFrame:
    """One ``<item>`` per row → struct column ``item``; pass
    ``COLLECTION_USER_ITEM_SCHEMA`` when only user_item rows are wanted. With ``subtype``,
    of which the row functions keep only items (P6), an item that is plainly of another
    one is NULL and not parsed: they drop it either way."""
    xml = F.col(xml_col)
    if subtype is not None:
        xml = F.when(~_of_other_subtype(xml, subtype), xml)
    return df.select(*keep, F.from_xml(xml, schema, XML_OPTIONS).alias("item"))


# --- S12 plays pages ---------------------------------------------------------------------

def parse_plays_pages(df: DataFrame, xml_col: str, user_id_col: str) -> tuple[DataFrame, DataFrame]:
    """Plays pages → (user_play rows, per-page (user_id, page, rows, total))."""
    p = df.select(F.col(user_id_col).cast("string").alias("user_id"),
                  F.from_xml(F.col(xml_col), PLAYS_PAGE_SCHEMA, XML_OPTIONS).alias("pg"))
    return plays_rows(p, "pg")


def parse_plays_page_counts(df: DataFrame, xml_col: str, user_id_col: str) -> DataFrame:
    """Plays pages → per-page (user_id, page, rows, total) only, parsing just the
    page attributes and one attribute per play (A9's input)."""
    p = df.select(F.col(user_id_col).cast("string").alias("user_id"),
                  F.from_xml(F.col(xml_col), PLAYS_PAGE_COUNT_SCHEMA, XML_OPTIONS).alias("pg"))
    return page_rows(p, "pg")


def page_rows(p: DataFrame, page_col: str = "pg", keep: Sequence[str] = ()) -> DataFrame:
    """Parsed plays pages → one row per page: page number, plays on it, declared total."""
    pg = F.col(page_col)
    return p.select("user_id", pg["_page"].try_cast("int").alias("page"),
                    F.coalesce(F.size(pg["play"]), F.lit(0)).alias("rows"),
                    F.coalesce(pg["_total"].try_cast("bigint"), F.lit(0)).alias("total"), *keep)


def plays_rows(p: DataFrame, page_col: str = "pg", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Parsed plays pages (``user_id`` + struct ``page_col``) → (user_play rows, per-page rows)."""
    plays = _explode_parsed(p, ["user_id", *keep], F.col(page_col)["play"], "x").select(
        _dflt(F.col("x._id")).alias("play_id"), "user_id",
        _dflt(F.col("x.item._objectid")).alias("objectid"),
        _dflt(F.col("x._date")).alias("play_date"), _dflt(F.col("x._quantity")).alias("quantity"),
        _dflt(F.col("x._length")).alias("length"), _dflt(F.col("x._incomplete")).alias("incomplete"),
        _dflt(F.col("x._location")).alias("location"), *keep)
    return plays, page_rows(p, page_col, keep)
