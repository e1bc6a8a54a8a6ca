"""Operator 9: vector bin packing of token sequences with the dot-product heuristic.

Every example asks for a vector of resources (tokens, one segment, loss-bearing
tokens); every sequence offers ``Limits``. A sequence is filled by repeatedly
taking, among the examples that fit in what is left, the one whose demand has
the largest dot product with the remaining capacity (both scaled by the
limits). When nothing fits whole, the best example is cut to fill the sequence
and its rest stays in the pool. A sequence that can no longer be filled gives
tokens back until its length is a power of two, so it needs no padding.

Packing runs inside each input partition over windows of ``window`` documents:
no shuffle, memory bounded by one window, and a lost task is simply rerun.

Defined results: a null text is empty and packs its closing id alone; an empty
table gives no rows; repeated rows are packed once each, as documents of their
own; a null id stays null; other columns are ignored; texts of any length are
cut into pieces, never truncated, runs of millions of blanks, line breaks or
letters included.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stagehand.llm.common import id_and_text, slices
from stagehand.llm.tokens import encoder

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, n_loss long")


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens in one sequence."""
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


def pack_window(lengths: np.ndarray, losses: np.ndarray, limits: Limits) -> np.ndarray:
    """Pack examples; the last ``losses[i]`` tokens of example i bear loss (a
    prompt comes first). Rows of the result: example, start, length, sequence,
    offset, loss-bearing tokens of the piece. Every token is in exactly one piece."""
    cap = np.array([limits.tokens, 1, limits.loss], dtype=float)
    out: list[tuple[int, int, int, int, int, int]] = []
    seq = 0
    n = len(lengths)
    start = np.zeros(n, dtype=np.int64)
    free = lengths - losses  # tokens before the loss-bearing tail
    if limits.loss >= limits.tokens:  # whole sequences cut from the front of long examples
        for i in np.flatnonzero(lengths >= limits.tokens):
            for s in range(0, int(lengths[i]) - limits.tokens + 1, limits.tokens):
                out.append((int(i), s, limits.tokens, seq, 0, int(min(limits.tokens, max(0, s + limits.tokens - free[i])))))
                seq += 1
            start[i] = lengths[i] // limits.tokens * limits.tokens
    # a pool of examples per demand vector: equal vectors score the same
    pool: dict[tuple[int, int], list[int]] = {}
    vectors = np.zeros((2 * n + 8, 2))
    slot_of: dict[tuple[int, int], int] = {}
    keys: list[tuple[int, int]] = []

    def put(i: int) -> None:
        t = int(lengths[i] - start[i])
        if t <= 0:
            return
        key = (t, int(min(t, losses[i])))
        if key not in slot_of:
            nonlocal vectors
            if len(keys) == len(vectors):
                vectors = np.concatenate([vectors, np.zeros_like(vectors)])
            slot_of[key] = len(keys)
            vectors[len(keys)] = key
            keys.append(key)
            alive.append(False)
        alive[slot_of[key]] = True
        pool.setdefault(key, []).append(i)

    alive: list[bool] = []
    for i in np.lexsort((np.arange(n), -(lengths - start))):
        put(int(i))
    left = sum(map(len, pool.values()))
    while left:
        rem_t, rem_l, rem_s = limits.tokens, limits.loss, limits.segments
        bin_: list[tuple[int, int, int, int]] = []
        while left and rem_t and rem_s:
            vec = vectors[:len(keys)]
            score = (vec[:, 0] * (rem_t / cap[0] ** 2) + rem_s / limits.segments ** 2
                     + vec[:, 1] * (rem_l / cap[2] ** 2))
            live = np.array(alive)
            fits = live & (vec[:, 0] <= rem_t) & (vec[:, 1] <= rem_l)
            whole = bool(fits.any())
            slot = int(np.argmax(np.where(fits if whole else live, score, -1.0)))
            key = keys[slot]
            i = pool[key].pop()
            left -= 1
            if not pool[key]:
                alive[slot] = False
            s, t = int(start[i]), key[0]
            p = min(t, rem_t, max(0, int(free[i]) - s) + rem_l)
            if p == 0:  # loss budget spent and this example bears loss from here on
                put(i)
                left += 1
                break
            loss = max(0, s + p - max(s, int(free[i])))
            bin_.append((i, s, p, loss))
            rem_t, rem_l, rem_s = rem_t - p, rem_l - loss, rem_s - 1
            start[i] += p
            if p < t:
                put(i)
                left += 1
        total = limits.tokens - rem_t
        if rem_t and total & (total - 1):  # give back the tokens over a power of two
            back = total - (1 << (total.bit_length() - 1))
            while back:
                i, s, p, loss = bin_.pop()
                cut = min(back, p)
                back -= cut
                for key, members in list(pool.items()):  # its rest may be in the pool already
                    if i in members:
                        members.remove(i)
                        left -= 1
                        if not members:
                            alive[slot_of[key]] = False
                        break
                start[i] = s + p - cut
                put(i)
                left += 1
                if cut < p:
                    bin_.append((i, s, p - cut, max(0, s + p - cut - max(s, int(free[i])))))
        off = 0
        for i, s, p, loss in bin_:
            out.append((i, s, p, seq, off, loss))
            off += p
        seq += 1
    return np.array(out, dtype=np.int64).reshape(-1, 6)


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   limits: Limits = Limits(), end_id: int = 0, window: int = 2000) -> DataFrame:
    """Tokenize whole texts, close each with ``end_id`` and pack all of them.

    One row per piece (schema ``PIECES``); every token but a document's first
    bears loss. Sequences are gapless, at most ``limits.tokens`` long and of a
    length that needs no padding (full, or a power of two).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base, used = TaskContext.get().partitionId() << 40, 0
        for b in slices(batches, window):
            ids = b.column(0)
            tokens = [np.array([*x, end_id], dtype="<u4") for x in encode(b.column(1).to_pylist())]
            lengths = np.array([len(x) for x in tokens], dtype=np.int64)
            p = pack_window(lengths, lengths - 1, limits)
            crc = [zlib.crc32(tokens[i][s:s + n].tobytes()) for i, s, n in p[:, :3]]
            yield pa.record_batch({
                "doc_id": ids.take(pa.array(p[:, 0])), "start": p[:, 1], "length": p[:, 2],
                "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": lengths[p[:, 0]],
                "sequence_id": base + used + p[:, 3], "offset": p[:, 4], "n_loss": p[:, 5]})
            used += int(p[:, 3].max()) + 1 if len(p) else 0

    return id_and_text(df, id_col, text_col).mapInArrow(run, PIECES)


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str,
                  limits: Limits = Limits(), window: int = 20_000) -> DataFrame:
    """Pack examples given by their counts of tokens and of loss-bearing tokens
    (the last ones of the example). Null counts are 0; an example without
    tokens gives no piece; loss counts are held to 0 … tokens."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 40, 0
        for whole in batches:
            for at in range(0, whole.num_rows, window):
                b = whole.slice(at, window)
                lengths = np.maximum(b.column(1).to_numpy(zero_copy_only=False), 0)
                losses = np.clip(b.column(2).to_numpy(zero_copy_only=False), 0, lengths)
                p = pack_window(lengths, losses, limits)
                yield pa.record_batch({"example_id": b.column(0).take(pa.array(p[:, 0])), "start": p[:, 1],
                                       "length": p[:, 2], "sequence_id": base + used + p[:, 3],
                                       "offset": p[:, 4], "n_loss": p[:, 5]})
                used += int(p[:, 3].max()) + 1 if len(p) else 0

    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("_t"),
                     F.coalesce(F.col(loss_col).cast("long"), F.lit(0)).alias("_l"))
    return rows.mapInArrow(run, "example_id long, start long, length long, sequence_id long, offset long, n_loss long")
