"""Parsing Python-literal list cells natively (F10, D15), without a Python UDF.

A legacy cell looks like ``[('1050', 'Heist'), ("7", "Tom's")]``. The whole cell
is first matched against a strict shape regex; a blank or malformed cell (three
fields, missing bracket, stray text, a raw line break or a broken escape inside
quotes) yields an empty array, never invented values. Valid cells are split with
``regexp_extract_all`` and unquoted. Quoted strings may hold commas, parentheses
and the other quote character. All escapes of a Python string are undone: quotes,
backslash, a b f n r t v, octal, hex and unicode ones (16 and 32 bit); an unknown
one keeps its backslash and a backslash before a line break joins the lines.
Named characters are not resolved, such a cell counts as malformed; a surrogate
has no text form and becomes U+FFFD. Bare integers are accepted as ids.

Every repetition is possessive: Java's matcher then loops instead of recursing,
so cells with thousands of pairs or very long strings do not exhaust its stack.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legacy list column → link type.
LINK_COLUMN_TO_TYPE = {
    "category": "boardgamecategory",
    "mechanic": "boardgamemechanic",
    "family": "boardgamefamily",
    "expansion": "boardgameexpansion",
    "accessory": "boardgameaccessory",
    "implementation": "boardgameimplementation",
    "designer": "boardgamedesigner",
    "artist": "boardgameartist",
    "publisher": "boardgamepublisher",
}

_WS = r"[ \t\n\r\f]*+"
_ESC = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|[^xuUN])"
_SQ = rf"'[^'\\\n\r]*+(?:{_ESC}[^'\\\n\r]*+)*+'"
_DQ = rf'"[^"\\\n\r]*+(?:{_ESC}[^"\\\n\r]*+)*+"'
STR_RE = f"(?:[uU]?(?:{_SQ}|{_DQ}))"
ATOM_RE = f"(?:{STR_RE}|[+-]?[0-9]++)"
PAIR_RE = rf"\({_WS}({ATOM_RE}){_WS},{_WS}({ATOM_RE}){_WS},?{_WS}\)"
PAIR_BARE = rf"\({_WS}{ATOM_RE}{_WS},{_WS}{ATOM_RE}{_WS},?{_WS}\)"


def _list_re(item: str) -> str:
    return rf"\A{_WS}\[{_WS}(?:{item}(?:{_WS},{_WS}{item})*+{_WS},?{_WS})?\]{_WS}\z"


PAIR_LIST_RE = _list_re(PAIR_BARE)
STR_LIST_RE = _list_re(STR_RE)
#: A string's plain runs and single escapes, for decoding.
_PIECE_RE = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|\r\n|[\s\S])|[^\\]++"
# One-letter escapes of a Python string.
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "a": "\x07", "b": "\x08", "f": "\x0c", "v": "\x0b",
            "\\": "\\", "'": "'", '"': '"', "\n": "", "\r": "", "\r\n": ""}


def _code_point(hex_digits: Column) -> Column:
    code = F.conv(hex_digits, 16, 10).cast("bigint")
    text = F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")
    return F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd")).otherwise(text)


def _unescape(piece: Column) -> Column:
    body = F.substring(piece, F.lit(2), F.length(piece))
    out = F.when(~piece.startswith("\\"), piece)
    out = out.when(piece.rlike(r"\A\\[xuU][0-9a-fA-F]"), _code_point(F.substring(piece, F.lit(3), F.length(piece))))
    out = out.when(piece.rlike(r"\A\\[0-7]"), _code_point(F.conv(body, 8, 16)))
    for letter, text in _LETTERS.items():
        out = out.when(body == F.lit(letter), F.lit(text))
    return out.otherwise(piece)


def unquote(col: Column) -> Column:
    """Strip the prefix and quotes of a Python string literal and undo its escapes."""
    quoted = col.rlike("\\A[uU]?['\"]")
    skip = F.when(col.rlike(r"\A[uU]"), F.lit(3)).otherwise(F.lit(2))
    inner = F.when(quoted, F.substring(col, skip, F.length(col) - skip)).otherwise(col)
    pieces = F.regexp_extract_all(inner, F.lit(_PIECE_RE), F.lit(0))
    return F.when(inner.contains("\\"), F.array_join(F.transform(pieces, _unescape), "")).otherwise(inner)


def parse_pair_list(col) -> Column:
    """Cell → array<struct<ref_id:string, value:string>>; blank/malformed → []."""
    c = F.col(col) if isinstance(col, str) else col
    ids = F.regexp_extract_all(c, F.lit(PAIR_RE), 1)
    vals = F.regexp_extract_all(c, F.lit(PAIR_RE), 2)
    pairs = F.arrays_zip(ids.alias("ref_id"), vals.alias("value"))
    parsed = F.transform(pairs, lambda p: F.struct(unquote(p["ref_id"]).alias("ref_id"),
                                                   unquote(p["value"]).alias("value")))
    empty = F.array().cast("array<struct<ref_id:string,value:string>>")
    return F.when(c.isNotNull() & c.rlike(PAIR_LIST_RE), parsed).otherwise(empty)


def parse_string_list(col) -> Column:
    """``['Strategy Game Rank', 'Family Game Rank']`` → array<string>; blank/malformed → []."""
    c = F.col(col) if isinstance(col, str) else col
    items = F.regexp_extract_all(c, F.lit(f"({STR_RE})"), 1)
    empty = F.array().cast("array<string>")
    return F.when(c.isNotNull() & c.rlike(STR_LIST_RE),
                  F.transform(items, unquote)).otherwise(empty)


def link_type_map() -> Column:
    """Legacy column name → link type, as a literal map column."""
    kv = []
    for k, v in LINK_COLUMN_TO_TYPE.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)
