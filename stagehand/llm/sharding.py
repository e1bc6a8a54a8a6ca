"""Operator 6: shards by extendible hashing under a byte limit.

A row's hash is 60 bits of the MD5 of its id and text. A bucket is a hash
prefix. All rows start in one bucket; only a bucket whose bytes exceed the
limit splits, on the next hash bit, until every bucket fits. The directory is
the list of final buckets (prefix, depth, bytes).

Scale: texts are read once, for their size and hash. The bytes of hash cells
(``round_bits`` more bits than the open buckets) are added up map-side first and
the splits of ``round_bits`` levels follow from these cells; only cells that
are still too large go into another round. Rows find their bucket by a join on
the cell, never by a broadcast directory; a hot bucket cannot arise, since
only equal rows share a hash.

Defined results: null id and null text hash as empty; a row larger than the
limit, or equal rows that exceed it together, form a bucket of their own that
no bit can split (``fits`` false); equal rows share a bucket; an empty table
gives no rows; other columns are ignored (``write_shards`` keeps them).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagehand.session import materialize

HASH_BITS = 60


def row_hash(id_col: str, text_col: str) -> Column:
    row = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright("h", HASH_BITS - depth)


def _split(cells: DataFrame, start: int, end: int, limit_bytes: int) -> DataFrame:
    """For each cell (a prefix of ``end`` bits) the smallest depth in start … end
    whose bucket fits or holds a single hash; null depth if there is none."""
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(end)))) \
        .withColumn("prefix", F.expr(f"shiftright(cell, {end} - depth)"))
    buckets = levels.groupBy("depth", "prefix").agg(
        F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    final = buckets.filter((F.col("shard_bytes") <= limit_bytes) | (F.col("lo") == F.col("hi")))
    found = levels.select("cell", "depth", "prefix").join(final, ["depth", "prefix"]).groupBy("cell").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("shard"))
    return cells.select("cell").join(found, "cell", "left")


def assign(df: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", round_bits: int = 12) -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, shard (the prefix bits), shard_bytes, shard_docs, fits."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    live = materialize(df.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n_bytes"),
                                 row_hash(id_col, text_col).alias("h")), "shard-rows")
    done, start = [], 0
    while True:
        end = min(start + round_bits, HASH_BITS)
        rows = live.withColumn("cell", _prefix(end))
        cells = materialize(rows.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"),
                                                     F.min("h").alias("lo"), F.max("h").alias("hi")), "shard-cells")
        cells = materialize(_split(cells, start, end, limit_bytes), "shard-directory")
        placed = rows.join(cells, "cell")
        if end == HASH_BITS or cells.filter("shard IS NULL").isEmpty():
            done.append(placed)
            break
        done.append(placed.filter("shard IS NOT NULL"))
        live = materialize(placed.filter("shard IS NULL").select("doc_id", "n_bytes", "h"), "shard-rows")
        start = end + 1 if end < HASH_BITS else end
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.expr("lpad(bin(shard.prefix), shard.depth, '0')")
    return out.select("doc_id", "n_bytes", F.col("shard.depth").cast("long").alias("depth"), bits.alias("shard"),
                      "shard.shard_bytes", "shard.shard_docs", (F.col("shard.shard_bytes") <= limit_bytes).alias("fits"), "h")


def write_shards(df: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the rows, all columns, as one Parquet folder per shard
    (``_shard=<bits>``) and returns the directory: shard, depth, shard_bytes,
    shard_docs. Rows of a shard meet in one task, which the limit bounds."""
    placed = assign(df, limit_bytes, id_col, text_col)
    directory = materialize(placed.select("shard", "depth", "shard_bytes", "shard_docs", "fits").distinct(), "shards")
    by_hash = placed.select("h", F.concat(F.lit("s"), "shard").alias("_shard")).distinct()
    rows = df.withColumn("_h", row_hash(id_col, text_col)).join(by_hash.withColumnRenamed("h", "_h"), "_h").drop("_h")
    rows.repartition("_shard").write.partitionBy("_shard").parquet(path)
    return directory


def oracle(limit_bytes: int, max_depth: int = 40) -> str:
    return f"""
WITH r AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
           FROM documents),
     lv AS (SELECT d, h >> (60 - d) AS p, sum(n_bytes) AS b, count(*) AS c, min(h) = max(h) AS single
            FROM r, range(0, {max_depth + 1}) t(d) GROUP BY 1, 2),
     pick AS (SELECT u.h, min(lv.d) AS d FROM (SELECT DISTINCT h FROM r) u JOIN lv ON lv.p = u.h >> (60 - lv.d)
              WHERE lv.b <= {limit_bytes} OR lv.single GROUP BY 1)
SELECT r.doc_id, CAST(r.n_bytes AS BIGINT) AS n_bytes, CAST(pick.d AS BIGINT) AS depth,
       lpad(bin(r.h >> (60 - pick.d)), CAST(pick.d AS INTEGER), '0') AS shard, CAST(lv.b AS BIGINT) AS shard_bytes,
       CAST(lv.c AS BIGINT) AS shard_docs, lv.b <= {limit_bytes} AS fits
FROM r JOIN pick USING (h) JOIN lv ON lv.d = pick.d AND lv.p = r.h >> (60 - pick.d)"""
