"""Operator 3: corpus-wide line dedup that returns keep bitmaps.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys of at least ``min_chars`` code points that occur in two documents or more
lose all their lines except in the document with the smallest id.

Each scan task hashes its lines (128 bits). Lines that it can decide alone (the
key occurs in a document with a smaller id in the same task) are dropped there,
so a line shared by a third of all documents leaves a task about once. The rest
is range-partitioned by hash with a secondary sort by document and position;
streaming each range keeps the first document of a key and drops the others,
holding one key at a time. What comes back is, per document, a compressed
bitmap of the lines to keep; texts are never shuffled to find duplicates.

Defined results: null or empty text is one empty line, kept; a document is its
id, so rows that repeat an id never drop each other's lines, and equal rows get
equal bitmaps; a null id counts as the largest id, all null ids as one document;
an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagehand.llm.common import slices
from stagehand.session import materialize

_LAST = 2**63 - 1
#: Most keys that a task remembers to decide lines alone; beyond it lines are only decided later.
_REMEMBER = 200_000

_KEYED = "h1 long, h2 long, id long, text_key long, pos int, n_lines int, dropped boolean"


def key_of(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key


def _rows(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("text_key"),
                     text.alias("_text"), *more)


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}  # smallest id so far of keys seen in two documents of this task
        for b in slices(batches, 4000):
            docs = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            here: dict[bytes, int] = {}
            lines: list[tuple[bytes, int, int, int, int]] = []
            for i, text_key, text in docs:
                parts = text.encode().split(b"\n")
                for pos, line in enumerate(parts):
                    key = key_of(line, min_chars)
                    if key is None:
                        continue
                    h = xxhash.xxh3_128_digest(key)
                    lines.append((h, i, text_key, pos, len(parts)))
                    old = here.get(h)
                    if old is None:
                        here[h] = least.get(h, i)
                        if here[h] > i:
                            here[h] = i
                    elif old != i:
                        here[h] = min(old, i)
                        if h in least or len(least) < _REMEMBER:
                            least[h] = here[h]
            if not lines:
                continue
            hashes = np.frombuffer(b"".join(x[0] for x in lines), dtype=">i8").astype(np.int64).reshape(-1, 2)
            rest = np.array([x[1:] for x in lines], dtype=np.int64)
            yield pa.record_batch({
                "h1": hashes[:, 0], "h2": hashes[:, 1], "id": rest[:, 0], "text_key": rest[:, 1],
                "pos": pa.array(rest[:, 2], pa.int32()), "n_lines": pa.array(rest[:, 3], pa.int32()),
                "dropped": [here[x[0]] < x[1] for x in lines]})

    return run


def _first_wins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hash, id, position): drops those whose id is not the first of their hash."""
    last = (None, None, 0)
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, ids = (b.column(k).to_numpy() for k in range(3))
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = (h1[0], h2[0]) != last[:2]
        at = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        first = np.where(at >= 0, ids[at], last[2])
        last = (h1[-1], h2[-1], first[-1])
        yield b.select([2, 3, 4, 5]).filter(pa.array(ids != first))


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, text_key, n_dropped, keep_bitmap) of the documents that lose a line.

    ``keep_bitmap``: zlib of one bit per line, 1 = keep. ``id`` is the largest
    long for a null id; ``text_key`` tells rows with the same id apart.
    """
    spark = df.sparkSession
    keyed = materialize(_rows(df, id_col, text_col).mapInArrow(_hash_lines(min_chars), _KEYED), "line-hashes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = (keyed.filter(~F.col("dropped")).select("h1", "h2", "id", "text_key", "pos", "n_lines")
              .repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", "id", "pos"))
    later = ranges.mapInArrow(_first_wins, "id long, text_key long, pos int, n_lines int")
    drops = keyed.filter("dropped").select("id", "text_key", "pos", "n_lines").unionByName(later)
    lists = drops.groupBy("id", "text_key").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps, n = [], []
            for n_lines, pos in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                keep = np.ones(n_lines, dtype=bool)
                keep[pos] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
                n.append(len(pos))
            yield pa.record_batch({"id": b.column(0), "text_key": b.column(1), "n_dropped": pa.array(n, pa.int64()),
                                   "keep_bitmap": pa.array(maps, pa.binary())})

    return lists.mapInArrow(bitmaps, "id long, text_key long, n_dropped long, keep_bitmap binary")


def kept_text(text: str, bitmap: bytes | None) -> str:
    """The lines that the bitmap keeps, joined by \\n."""
    if bitmap is None:
        return text
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def _joined(df: DataFrame, maps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = _rows(df, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    return rows.join(maps, ["id", "text_key"], "left").select("_row", "_text", "n_dropped", "keep_bitmap")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap (null: all kept), one row per document."""
    narrow = df.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"))
    joined = _joined(narrow, keep_bitmaps(narrow, "id_", "text_", min_chars), "id_", "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4000):
            texts, maps = b.column(1).to_pylist(), b.column(3).to_pylist()
            sha = [hashlib.sha256(kept_text(t, m).encode()).hexdigest() for t, m in zip(texts, maps, strict=True)]
            yield pa.record_batch({"doc_id": b.column(0), "n_lines": [t.count("\n") + 1 for t in texts],
                                   "n_dropped": b.column(2).fill_null(0), "kept_sha256": sha, "keep_bitmap": b.column(3)})

    slim = joined.select(F.col("_row.id_").alias("doc_id"), "_text", "n_dropped", "keep_bitmap")
    return slim.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_bitmap binary")


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """The documents, all columns, without their dropped lines (a null text stays null)."""
    joined = _joined(df, keep_bitmaps(df, id_col, text_col, min_chars), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4000):
            kept = [kept_text(t, m) for t, m in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(kept, pa.string())], names=["_row", "_kept"])

    row = joined.schema["_row"].dataType.simpleString()
    out = joined.mapInArrow(run, f"_row {row}, _kept string")
    kept = F.when(F.col("_row").getField(text_col).isNotNull(), F.col("_kept"))
    return out.select(*[(kept if c == text_col else F.col("_row").getField(c)).alias(c) for c in df.columns])
