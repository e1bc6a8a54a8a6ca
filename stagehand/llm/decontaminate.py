"""Operator 10: benchmark decontamination with a broadcast set of test n-grams.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII
characters. A window is ``n`` consecutive words of an item; an item of fewer
words, but not none, is one window. Every word of a document inside any
occurrence of a window is hit. The window hashes are broadcast as a sorted
array; hash hits are verified word by word before they count.

The benchmark is broadcast only in blocks of at most ``max_block_words`` words
(so no more windows) and ``max_block_bytes`` bytes of them; a larger benchmark is held against the corpus block by
block (a stated query set against all rows) and the hits of the blocks are
merged, so the result does not depend on the number of blocks.

Defined results: null or empty texts have no words and no hits; an empty
benchmark leaves everything clean; repeated rows are each judged alone; equal
item ids count once and a null item id hits words but is not counted or listed;
no items gives the digest of the empty string; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagehand.llm.common import slices
from stagehand.session import materialize

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class WindowSet:
    """Windows of one benchmark block in arrays: the word numbers of its pieces one
    after the other and, per window length, the sorted hashes of the different
    windows, the place of each in the words, and its items. Some tens of bytes a
    window; besides them only the different words are Python objects."""

    def __init__(self, pieces: list[tuple[int | None, list[bytes]]], n: int):
        self.vocab: dict[bytes, int] = {}
        number = self.vocab.setdefault
        parts = [np.fromiter((number(w, len(self.vocab) + 1) for w in words), dtype=np.uint32, count=len(words)) for _, words in pieces]
        self.words = np.concatenate([np.zeros(0, dtype=np.uint32), *parts])
        self.item = np.array([i or 0 for i, _ in pieces], dtype=np.int64)
        self.nameless = np.array([i is None for i, _ in pieces], dtype=bool)
        size = np.array([len(x) for x in parts], dtype=np.int64)
        start, length = np.cumsum(size) - size, np.minimum(size, n)
        self.windows = {int(m): self._sorted(int(m), np.flatnonzero(length == m), start, size) for m in np.unique(length[length > 0])}

    def _sorted(self, m: int, pieces: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hash and place of each different window, bounds of its pieces in ``who``, most windows of one hash."""
        count = size[pieces] - m + 1
        who = np.repeat(pieces, count).astype(np.int32)
        at = np.repeat(start[pieces] - (np.cumsum(count) - count), count) + np.arange(len(who))
        h = self._hash(self.words, at, m)
        order = np.argsort(h, kind="stable")
        new = h[order][1:] != h[order][:-1]
        if not self._same(at[order][1:], self.words, at[order][:-1], m)[~new].all():  # a collision: by the words, too
            order = np.lexsort((*(self.words[at + k] for k in range(m)), h))
            new = (h[order][1:] != h[order][:-1]) | ~self._same(at[order][1:], self.words, at[order][:-1], m)
        h, at, who = h[order], at[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], new]))
        h = h[first]
        run = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h, at[first].astype(np.int32), np.append(first, len(who)).astype(np.int32), who, int(np.diff(run, append=len(h)).max())

    def __getstate__(self):  # the words as one string: pickle would remember each
        return self.__dict__ | {"vocab": b" ".join(self.vocab)}

    def __setstate__(self, state):
        self.__dict__.update(state, vocab={w: k for k, w in enumerate(state["vocab"].split(), 1)})

    @staticmethod
    def _hash(ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(m):
            h = (h ^ ids[at + k]) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def _same(self, at: np.ndarray, ids: np.ndarray, other: np.ndarray, m: int) -> np.ndarray:
        """Whether the ``m`` words at ``at`` here are those at ``other`` in ``ids``."""
        same = np.ones(len(at), dtype=bool)
        for k in range(m):
            same &= self.words[at + k] == ids[other + k]
        return same

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int | None]]:
        """Verified hits of a document: merged word ranges [from, to) and the items hit."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint32, count=len(words))
        hits: list[tuple[int, int]] = []
        found: set[int | None] = set()
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for m, (hashes, place, bounds, who, most) in self.windows.items():
            if len(ids) < m:
                continue
            at = np.flatnonzero(known[m:] - known[:-m] == m)  # windows of benchmark words only
            if not len(at):
                continue
            h = self._hash(ids, at, m)
            k = np.searchsorted(hashes, h)
            for _ in range(most):
                near = np.flatnonzero(hashes[np.minimum(k, len(hashes) - 1)] == h)
                near = near[k[near] < len(hashes)]
                near = near[self._same(place[k[near]], ids, at[near], m)]
                hits += [(i, i + m) for i in at[near].tolist()]
                for w in np.unique(k[near]):
                    mine = who[bounds[w]:bounds[w + 1]]
                    found.update(self.item[mine[~self.nameless[mine]]].tolist())
                    if self.nameless[mine].any():
                        found.add(None)
                k = k + 1
        return merge(hits), found


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def without_spans(text: str | None, hits: list[tuple[int, int]]) -> str | None:
    """The text without the words of each range and all between them. Folding
    keeps every byte in place, so word positions there are byte positions here."""
    if not hits:
        return text
    raw = text.encode()
    inside = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    out, at = [], 0
    for a, z in hits:
        out.append(raw[at:edges[2 * a]])
        at = int(edges[2 * z - 1])
    return b"".join([*out, raw[at:]]).decode()


def digest_items(found: set[int | None]) -> tuple[int, str]:
    ids = sorted(str(i) for i in found if i is not None)
    return len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int, max_words: int,
            max_bytes: int) -> Iterator[tuple[WindowSet, bool]]:
    """Blocks of items of at most ``max_words`` words and ``max_bytes`` bytes of
    words each, and whether it is the last. A longer item is cut into pieces that
    overlap by ``n`` - 1 words, so that each of its windows is in one; a piece has
    a block of its own at most. The different rows stream through the driver."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    step = max(1, max_words - n + 1)
    block: list[tuple[int | None, list[bytes]]] = []
    n_words = n_bytes = 0
    for r in rows.toLocalIterator():
        words = words_of(r.t or "")
        for at in range(0, max(1, len(words) - n + 1) if words else 0, step):
            piece = words[at:at + step + n - 1]
            size = sum(map(len, piece))
            if block and (n_words + len(piece) > max_words or n_bytes + size > max_bytes):
                full, block, n_words, n_bytes = WindowSet(block, n), [], 0, 0
                yield full, False
                del full
            block.append((r.i, piece))
            n_words, n_bytes = n_words + len(piece), n_bytes + size
    yield WindowSet(block, n), True


def _scan(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
          n: int, max_block_bytes: int, max_block_words: int, carry: bool) -> DataFrame:
    """Rows of ``REPORT`` and, with ``carry``, the input row (``_row``) and its
    text without the hit spans (``_clean``). One pass for each benchmark block;
    between passes the hits so far are written to the shared folder."""
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")] if carry else []
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                     F.array().cast("array<long>").alias("_from"), F.array().cast("array<long>").alias("_to"),
                     F.array().cast("array<long>").alias("_items"), *row)
    between = rows.schema
    done = [f.strip() for f in REPORT.split(",")] + ([f"_row {rows.schema['_row'].dataType.simpleString()}", "_clean string"] if carry else [])
    sc = df.sparkSession.sparkContext
    for block, last in _blocks(benchmark, item_col, item_text_col, n, max_block_words, max_block_bytes):
        shared = sc.broadcast(block)
        rows = rows.mapInArrow(_pass(shared, last, carry), ", ".join(done) if last else between)
        if not last:
            rows = materialize(rows, "benchmark-hits")
            shared.destroy()
    return rows


def _pass(shared, last: bool, carry: bool):
    """Adds one block's hits to each row; the last pass judges the merged hits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            out = []
            for text, old_from, old_to, old_items in zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True):
                words = words_of(text or "")
                hits, found = shared.value.scan(words)
                hits += zip(old_from, old_to, strict=True)
                found |= set(old_items)
                if not last:
                    out.append(([a for a, _ in hits], [z for _, z in hits], list(found)))
                    continue
                hits = merge(hits)
                n_hit = sum(z - a for a, z in hits)
                out.append((len(words), n_hit, *digest_items(found), n_hit > 0, *([without_spans(text, hits)] if carry else [])))
            cols = [pa.array(c) for c in zip(*out, strict=True)]
            kept = [b.column(5)] if carry else []
            if last:
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] + ["_row", "_clean"] * carry
                yield pa.record_batch([b.column(0), *cols[:5], *kept, *([cols[5].cast(pa.string())] if carry else [])], names=names)
            else:
                long_list = pa.list_(pa.int64())
                yield pa.record_batch([b.column(0), b.column(1), *(c.cast(long_list) for c in cols), *kept], names=b.schema.names)

    return run


def find_hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", n: int = 10, max_block_bytes: int = 32 << 20,
              max_block_words: int = 1 << 20) -> DataFrame:
    """One row per document (schema ``REPORT``)."""
    return _scan(df, benchmark, id_col, text_col, item_col, item_text_col, n, max_block_bytes, max_block_words, carry=False)


def remove_hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                item_text_col: str = "text", n: int = 10, max_block_bytes: int = 32 << 20,
                max_hit_share: float = 1.0, max_block_words: int = 1 << 20) -> DataFrame:
    """The documents with every hit span cut out of their text; a document of
    which more than ``max_hit_share`` of the words are hit is removed whole.
    All columns are kept; clean texts, null ones included, are untouched."""
    out = _scan(df, benchmark, id_col, text_col, item_col, item_text_col, n, max_block_bytes, max_block_words, carry=True)
    out = out.filter(F.col("n_hit") <= F.col("n_words") * F.lit(max_hit_share))
    return out.select(*[(F.col("_clean") if c == text_col else F.col("_row").getField(c)).alias(c) for c in df.columns])
