"""Schema conformance and wide → long reshapes.

Legacy exports carry extra (sometimes personal) columns, miss others, and pack
bridge tables into list-literal cells. These operators bring them to the raw
schema with projections and one ``unpivot`` + ``inline`` — all native, so the
reshape runs inside the scan stage with no shuffle.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import LINK_COLUMN_TO_TYPE, parse_pair_list, parse_string_list
from ..schemas import RAW_FIELDS


def conform(df: DataFrame, fields: Sequence[str], fill: str | None = "",
            constants: Mapping[str, str] | None = None) -> DataFrame:
    """Select exactly ``fields`` in order (P1); absent ones become ``fill`` (P2);
    ``constants`` override a column with a literal (P3). Extra columns are dropped."""
    constants = constants or {}
    have = set(df.columns)
    cols = []
    for c in fields:
        if c in constants:
            cols.append(F.lit(constants[c]).cast("string").alias(c))
        elif c in have:
            cols.append(F.col(c).cast("string").alias(c))
        else:
            cols.append(F.lit(fill).cast("string").alias(c))
    return df.select(*cols)


def require(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Exactly ``fields`` in order (P1); a missing one raises, it is never filled."""
    missing = [c for c in fields if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {df.columns}")
    return conform(df, fields)


def adapt_user_info(df: DataFrame) -> DataFrame:
    """Legacy users → raw user_info (drops names, avatar, web and console accounts)."""
    return require(df, RAW_FIELDS["user_info"])


def adapt_item_info(df: DataFrame) -> DataFrame:
    return require(df, RAW_FIELDS["item_info"])


def adapt_user_item(df: DataFrame) -> DataFrame:
    """Legacy collection rows were all owned: own='1'; other status flags blank."""
    return conform(df, RAW_FIELDS["user_item"], fill="", constants={"own": "1"})


def unpivot_links(df: DataFrame, id_col: str = "objectid",
                  mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Wide list-literal columns → long (objectid, link_type, ref_id, value).

    ``stack``-style unpivot of the present list columns, cell parse (F10), then
    ``inline``: an empty or malformed cell yields no row.
    """
    mapping = dict(mapping or LINK_COLUMN_TO_TYPE)
    present = [c for c in mapping if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "objectid string, link_type string, ref_id string, value string")
    type_of = F.create_map(*[x for c in present for x in (F.lit(c), F.lit(mapping[c]))])
    long = df.select(F.col(id_col).cast("string").alias("objectid"),
                     *[F.col(c).cast("string").alias(c) for c in present]) \
             .unpivot(["objectid"], present, "_col", "_cell")
    parsed = long.select("objectid", F.element_at(type_of, F.col("_col")).alias("link_type"),
                         parse_pair_list("_cell").alias("_pairs"))
    return parsed.select("objectid", "link_type", F.inline("_pairs"))


def adapt_item_details(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legacy details → (raw item_details, raw item_link) (U2 + U1).

    The legacy file has no year; it is left blank here and filled in staging from
    the item table. ``avg_weights`` passes through.
    """
    details = conform(df, RAW_FIELDS["item_details"], constants={"yearpublished": ""})
    links = unpivot_links(df)
    return details, links


def explode_string_list(df: DataFrame, id_col: str, list_col: str, out_col: str) -> DataFrame:
    """``['A', 'B']`` cell → one row per element (D15); blank/malformed → no row."""
    return df.select(F.col(id_col), F.explode(parse_string_list(list_col)).alias(out_col))
