"""Operator 4: quality classifier by importance resampling.

Two generative models over hashed n-grams: ``target`` from the documents that
the labels call good, ``raw`` from all documents. A document's log weight is the
mean log ratio target/raw of its n-grams, scaled to an effective length, so
long documents do not win by length alone. n-grams whose target count does not
differ clearly from what the raw model expects (``min_z`` standard deviations
and a factor of ``min_ratio``) back off to the raw model, that is to a ratio of
1. Log weights plus Gumbel noise (a hash of seed, id and text) give the keys;
the documents with the k largest keys are the sample, which is a draw without
replacement in proportion to the weights (Gumbel top-k).

Scale: counts are added up in one array per task and leave it as sparse blocks
of buckets; the two models have ``1 << bits`` buckets whatever the input, so
collecting and broadcasting them is bounded. Target ids are a hash sample of at
most ``max_target`` labelled rows (the documented bound of the fit); raw counts,
weights and the threshold cover all documents. The k-th largest key is found by
histograms of the keys, never by sorting them in one task.

Defined results: null text is empty, has no n-gram and log weight 0; ties at the
k-th key are all kept, so repeated rows share their fate; an empty table gives
no rows; without good labels every ratio is 1 and every document is kept; null
labels are not good; a null id is never a target; other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from stagehand.llm.common import slices
from stagehand.session import materialize

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 14  # buckets of a block: 1 << 14


@dataclass(frozen=True)
class Params:
    n: int = 6  # bytes of an n-gram of the lower-cased text
    bits: int = 20
    min_z: float = 3.0
    min_ratio: float = 2.0
    effective_length: float = 200.0
    max_target: int = 200_000
    seed: int = 17


def buckets(texts: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every text (a space is put before and after it),
    and the end of each text's n-grams in that array."""
    raws = [f" {t} ".lower().encode() if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    count = max(0, len(data) - p.n + 1)
    h = np.zeros(count, dtype=np.uint64)
    for k in range(p.n):
        h += data[k:count + k]
        h *= _MIX
        h ^= h >> np.uint64(32)
    valid = np.ones(count, dtype=bool)  # n-grams that run over a text's end are none
    for k in range(1, p.n):
        cut = ends - k
        valid[cut[(cut >= 0) & (cut < count)]] = False
    out = (h >> np.uint64(64 - p.bits)).astype(np.int32)[valid]
    return out, np.cumsum(np.maximum(0, sizes - p.n + 1))


def _counts(ids: np.ndarray, p: Params):
    """Per task: counts of all and of target documents, as sparse blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, tgt = np.zeros(1 << p.bits, dtype=np.int64), np.zeros(1 << p.bits, dtype=np.int64)
        seen = False
        for b in slices(batches, 4000):
            seen = True
            got, ends = buckets(b.column(1).to_pylist(), p)
            raw += np.bincount(got, minlength=1 << p.bits)
            doc = b.column(0)
            mine = np.isin(doc.fill_null(0).to_numpy(zero_copy_only=False), ids) & doc.is_valid().to_numpy(zero_copy_only=False)
            if mine.any():
                tgt += np.bincount(got[np.repeat(mine, np.diff(ends, prepend=0))], minlength=1 << p.bits)
        for k in range(1 << (p.bits - _BLOCK)) if seen else ():
            part = slice(k << _BLOCK, (k + 1) << _BLOCK)
            at = np.flatnonzero(raw[part])
            blob = at.astype("<u2").tobytes() + raw[part][at].astype("<i8").tobytes() + tgt[part][at].astype("<i8").tobytes()
            yield pa.record_batch({"block": pa.array([k], pa.int32()), "cells": pa.array([blob], pa.binary())})

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sparse blocks of each block number; holds one task's blocks only."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            m = len(blob) // 18
            at = np.frombuffer(blob, "<u2", m)
            s = sums.setdefault(block, np.zeros((2, 1 << _BLOCK), dtype=np.int64))
            s[0, at] += np.frombuffer(blob, "<i8", m, 2 * m)
            s[1, at] += np.frombuffer(blob, "<i8", m, 10 * m)
    for block, s in sums.items():
        yield pa.record_batch({"block": pa.array([block], pa.int32()), "cells": pa.array([s.tobytes()], pa.binary())})


@dataclass(frozen=True)
class Model:
    log_ratio: np.ndarray
    keep_share: float


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Both models from one scan of all documents; the share of good labels."""
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    marks = labels.select(F.col(id_col).cast("long").alias("_id"), good.alias("_good"))
    total = marks.agg(F.count("*").alias("n"), F.count_if("_good").alias("g")).first()
    share = total.g / total.n if total.g else 1.0
    wanted = marks.filter(F.col("_good") & F.col("_id").isNotNull()).select("_id").distinct()
    if total.g > p.max_target:  # a uniform part of the ids, by hash; the order makes it the same one each time
        part = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
        wanted = wanted.filter(part < int(p.max_target / total.g * (1 << 30))).orderBy(part, "_id")
    ids = wanted.limit(p.max_target).toPandas()["_id"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(ids))
    run = lambda batches: _counts(shared.value, p)(batches)
    parts = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(
        run, "block int, cells binary")
    sums = parts.repartition(1 << (p.bits - _BLOCK), "block").mapInArrow(_add_up, "block int, cells binary")
    raw, tgt = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    for r in sums.toLocalIterator():  # 1 << (bits - 14) rows, whatever the input
        raw[r.block << _BLOCK:][:1 << _BLOCK], tgt[r.block << _BLOCK:][:1 << _BLOCK] = np.frombuffer(r.cells, np.int64).reshape(2, -1)
    shared.destroy()
    return Model(_log_ratio(raw, tgt, p), share)


def _log_ratio(raw: np.ndarray, tgt: np.ndarray, p: Params) -> np.ndarray:
    if not tgt.any():
        return np.zeros(len(raw), dtype=np.float32)
    expect = raw * (tgt.sum() / raw.sum())
    ratio = np.log((tgt + 1) / (expect + 1))
    clear = ((tgt - expect) ** 2 > p.min_z ** 2 * (expect + 1)) & (np.abs(ratio) > math.log(p.min_ratio))
    return np.where(clear, ratio, 0).astype(np.float32)


def weigh(docs: DataFrame, model: Model, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' own columns and ``_log_weight``, ``_key`` (with the noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.log_ratio)
    unit = (F.pmod(F.xxhash64(F.lit(p.seed), F.col(id_col), F.col(text_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"), (-F.log(-F.log(unit))).alias("_noise"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4000):
            got, ends = buckets(b.column(1).to_pylist(), p)
            sums = np.concatenate([[0.0], np.cumsum(shared.value[got], dtype=np.float64)])[np.concatenate([[0], ends])]
            weight = np.diff(sums) / np.maximum(1, np.diff(ends, prepend=0)) * p.effective_length
            weight = np.round(weight, 9)  # sums over a batch differ in their last bits with its other rows
            yield pa.record_batch([b.column(0), pa.array(weight), pa.array(weight + b.column(2).to_numpy())],
                                  names=["_row", "_log_weight", "_key"])

    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, _log_weight double, _key double"
    return rows.mapInArrow(run, schema)


def kth_largest(keys: DataFrame, col: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value, by narrowing histograms of ``bins`` cells (None: fewer than k rows)."""
    span = keys.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n")).first()
    if k > span.n or k < 1:
        return None
    lo, hi = span.lo, span.hi
    while hi > lo:
        cell = F.least(F.floor((F.col(col) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
        inside = keys.filter(F.col(col).between(lo, hi))
        rows: list[Row] = (inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
                           .orderBy(F.desc("c")).collect())  # at most ``bins`` rows
        for r in rows:
            if k <= r.n:
                lo, hi = r.lo, r.hi
                break
            k -= r.n
    return lo


@dataclass(frozen=True)
class Selection:
    model: Model
    threshold: float
    scores: DataFrame


def select(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, p: Params = Params(),
           id_col: str = "doc_id", text_col: str = "text") -> Selection:
    """Fits, weighs all documents and finds the key of the last one kept. k is
    ``keep_share`` of the documents; by default the share of good labels."""
    model = fit(docs, labels, p, id_col, text_col)
    scores = materialize(weigh(docs.select(id_col, text_col), model, p, id_col, text_col)
                         .select(F.col(f"_row.{id_col}").alias(id_col), "_log_weight", "_key"), "importance")
    k = math.ceil((model.keep_share if keep_share is None else keep_share) * scores.count())
    threshold = kth_largest(scores, "_key", k)
    return Selection(model, -math.inf if threshold is None else threshold, scores)


def classify(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, p: Params = Params(),
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, log weight, key and whether it is in the sample."""
    s = select(docs, labels, keep_share, p, id_col, text_col)
    return s.scores.select(F.col(id_col), F.col("_log_weight").alias("log_weight"), F.col("_key").alias("sample_key"),
                           (F.col("_key") >= s.threshold).alias("kept"))


def keep_sample(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, p: Params = Params(),
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the sample, all columns. Texts are weighed again in place
    of joining them with their scores: a narrow pass, no shuffle of the texts."""
    s = select(docs, labels, keep_share, p, id_col, text_col)
    return (weigh(docs, s.model, p, id_col, text_col).filter(F.col("_key") >= s.threshold)
            .select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
