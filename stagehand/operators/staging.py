"""Raw → staged typing, enrichment and layout.

Staging is a projection with guarded casts (see ``functions.casts``); Catalyst
keeps it inside one codegen stage with the scan, and column pruning reaches the
parquet reader. Enrichment is a left join (coverage is partial, an inner join
would silently drop items).
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import cast_kind, safe_int
from ..schemas import STAGED_KINDS

# The four per-type link views (view, link type, id alias, value alias).
LINK_VIEWS = [
    ("item_category", "boardgamecategory", "category_id", "category"),
    ("item_mechanic", "boardgamemechanic", "mechanic_id", "mechanic"),
    ("item_designer", "boardgamedesigner", "designer_id", "designer"),
    ("item_publisher", "boardgamepublisher", "publisher_id", "publisher"),
]


def stage(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Typed projection: one guarded cast per column, in the given order (S6 body)."""
    return df.select([cast_kind(c, k).alias(c) for c, k in kinds.items()])


def stage_table(raw: DataFrame, table: str) -> DataFrame:
    """Stage a registered raw table by its kind map."""
    if table not in STAGED_KINDS:
        raise ValueError(f"no staging rules for {table!r}")
    return stage(raw, STAGED_KINDS[table])


def stage_item_details(details_raw: DataFrame, item_info_staged: DataFrame) -> DataFrame:
    """Typed details; a blank year is filled from the item table (J1 + F7).

    ``details LEFT JOIN item_info USING (objectid)``; the item side is projected to
    two columns before the join so only they are shuffled (or broadcast by AQE).
    """
    items = item_info_staged.select("objectid", F.col("yearpublished").alias("_info_year"))
    d = details_raw.alias("d")
    j = d.join(items, on="objectid", how="left")
    return j.select(
        "objectid", "name",
        F.coalesce(safe_int("yearpublished"), F.col("_info_year")).alias("yearpublished"),
        cast_kind("minage", "int").alias("minage"),
        "description",
        cast_kind("avg_weights", "double").alias("avg_weights"),
    )


def enrich_left(fact: DataFrame, dim: DataFrame, key: str, fill: Mapping[str, str]) -> DataFrame:
    """Generic J1: ``fact LEFT JOIN dim USING (key)`` with ``coalesce(fact.c, dim.c)``.

    ``fill`` maps a fact column to the dim column that fills it when NULL.
    """
    dim_cols = [F.col(key)] + [F.col(dc).alias(f"_dim_{dc}") for dc in set(fill.values())]
    j = fact.join(dim.select(*dim_cols), on=key, how="left")
    out = []
    for c in fact.columns:
        if c in fill:
            out.append(F.coalesce(F.col(c), F.col(f"_dim_{fill[c]}")).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def link_view(stg_link: DataFrame, link_type: str, id_alias: str, value_alias: str,
              key: str = "objectid") -> DataFrame:
    """One per-type view of the link bridge: filter then rename (P5 + P4)."""
    return (stg_link.where(F.col("link_type") == F.lit(link_type))
                    .select(key, F.col("ref_id").alias(id_alias), F.col("value").alias(value_alias)))


def register_link_views(stg_link: DataFrame) -> dict[str, DataFrame]:
    """Create-or-replace the four link views as temp views."""
    views = {}
    for name, lt, ida, va in LINK_VIEWS:
        v = link_view(stg_link, lt, ida, va)
        v.createOrReplaceTempView(name)
        views[name] = v
    return views


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename legacy columns (D16), e.g. {'rating_cnt': 'usersrated'}; absent names are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


# --- physical layout -------------------------------------------------------------

def cluster_by_key(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Range-cluster rows by ``key`` (S8) so parquet min/max stats prune on it.

    The range is taken over (key, row hash): a key holding a third of all rows is
    then cut across several output files instead of landing in one writer task,
    while files stay ordered and non-overlapping on ``key``. Without
    ``partitions`` the file count is left to adaptive execution, which sizes
    the ranges from the measured data.
    """
    tiebreak = F.xxhash64(*[F.col(c) for c in df.columns])
    cols = (F.col(key), tiebreak)
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return ranged.sortWithinPartitions(key)


def write_clustered(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """Create-or-replace a clustered table (S6 + S8): idempotent overwrite."""
    cluster_by_key(df, key, partitions).write.mode("overwrite").parquet(path)


def create_table_as(spark: SparkSession, df: DataFrame, name: str, path: str | None = None,
                    cluster_key: str | None = None, partitions: int | None = None) -> None:
    """CREATE OR REPLACE TABLE name AS SELECT … (S6), optionally clustered."""
    out = df
    if cluster_key:
        out = cluster_by_key(df, cluster_key, partitions or spark.sparkContext.defaultParallelism)
    w = out.write.mode("overwrite").format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Create-or-replace a table bucketed and sorted by ``key`` (S8, co-location form).

    Two tables bucketed the same way on the same key join without a shuffle
    (the item-grain staging tables, keyed by ``objectid``, are the use case).
    A key holding a large share of rows would make one bucket large, so for
    skewed keys ``cluster_by_key`` (range on key + hash) is the layout to use.
    """
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


# --- co-location -----------------------------------------------------------------

def write_colocated(tables: Mapping[str, DataFrame], key: str, buckets: int, directory: str) -> None:
    """Create-or-replace ``tables`` (name → rows) as catalog tables with the same
    buckets of ``key``, files under ``directory``, each with a bloom filter of the
    key: joins of any of them on ``key`` need no shuffle, and a lookup of one key
    reads one bucket. For keys of which none holds a large share of a table (item
    keys); one file a bucket, so the merge of a join needs no sort either."""
    for name, df in tables.items():
        (df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
           .option("path", f"{directory}/{name}").option(f"parquet.bloom.filter.enabled#{key}", "true").saveAsTable(name))


def read_colocated(spark: SparkSession, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of ``write_colocated``."""
    return {n: spark.table(n) for n in names}


def colocated_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join of two co-located tables bucket by bucket, neither side moved. (Without the
    hint a small side would be sent to all tasks, which is no better here.)"""
    return left.join(right.hint("merge"), key, how)


def lookup(table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """The rows of some keys: only their buckets' files are read, and of these the row
    groups whose statistics and bloom filter may hold them."""
    return table.where(F.col(key).isin(list(values)) if len(values) != 1 else F.col(key) == F.lit(values[0]))
