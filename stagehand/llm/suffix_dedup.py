"""Operator 1: byte-level dedup of repeated strings by hash-compared suffix sort.

Removes each byte that lies in a string of ``length`` bytes which also starts
anywhere else, in the same text or another. Strings are judged on the input.

The suffixes of all texts are never sorted in one place. They are dealt by
content: every window of ``length`` bytes belongs to its anchor, the leftmost
of its ``gram``-byte strings with the smallest hash, so equal windows have equal
anchors. Runs of windows with the same anchor form a cell (a text of
``length`` - 1 + its number of windows bytes). Then

1. buckets of anchors find those that occur twice or more; other cells leave;
2. equal cells are counted by a digest: a cell that occurs twice is all
   repeated, however often it occurs, and goes on once;
3. the different cells of an anchor meet, and the suffixes that start at their
   windows are mergesorted. Suffixes are compared by their longest common
   extension, which a binary search over prefix polynomial hashes finds, so a
   comparison costs the logarithm of the length. Neighbours that share
   ``length`` bytes are repeated; they are verified byte by byte, and where a
   hash collision shows, the suffixes of that anchor are sorted as bytes.
4. anchors with over ``hot_cells`` cells (an edge of a passage that very many
   texts share) are not gathered: their windows are dealt by digest instead, as
   many small buckets as they need, and compared there.

Scale: what is shuffled are anchors (one per about 37 bytes), the cells of
repeated anchors, and each text twice, compressed; copies of a text are dealt
once per task. Nothing is collected.

Defined results: null text is empty; texts under ``length`` bytes lose nothing;
equal texts of ``length`` bytes or more lose everything; rows that repeat an id
are texts of their own; a null id stays null; an empty table gives no rows;
other columns are ignored; offsets are bytes of the UTF-8 text.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagehand.llm.common import id_and_text, slices
from stagehand.session import materialize

#: Bytes of a text that are hashed at a time (positions must fit in 24 bits).
_CHUNK = 4 << 20
#: Anchors of a bucket: bounds the arrays of one task.
_BUCKET_ANCHORS = 1_500_000
#: Windows of hot anchors of a bucket.
_HOT_WINDOWS = 500_000
#: Bytes of cells that are sorted at a time, unless one anchor has more.
_SORT_BYTES = 1 << 20

_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DEAL = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class PrefixHashes:
    """Polynomial hashes modulo 2**64 of every prefix of a byte string; the hash
    of any substring follows from two of them."""

    _values = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
    _up = _down = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(PrefixHashes._up) <= n:
            size = n + n // 4 + 1024
            PrefixHashes._up = _powers(_BASE, size)
            PrefixHashes._down = _powers(pow(_BASE, -1, 1 << 64), size)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self._values[data] * self._up[:n], out=self.prefix[1:])

    def every(self, length: int) -> np.ndarray:
        """Hash of the substring of ``length`` bytes at every position."""
        h = self.prefix[length:] - self.prefix[:len(self.prefix) - length]
        return h * self._down[:len(h)]

    def at(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self._down[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the longest common extension of the suffixes at a and b, up to ``most``."""
        lo, hi = np.zeros(len(a), dtype=np.int64), np.full(len(a), most, dtype=np.int64)
        for _ in range(most.bit_length()):
            mid = (lo + hi + 1) // 2
            same = self.at(a, mid) == self.at(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo


def suffix_sort(data: np.ndarray, starts: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, PrefixHashes]:
    """Order of the suffixes at ``starts`` by (group, first ``most`` bytes): a
    bottom-up mergesort of each group, in which the place of an element in the
    other run is found by binary search with hash-compared suffixes."""
    hashes = PrefixHashes(data)

    def before(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = hashes.common(a, b, most)
        full = n == most
        step = np.where(full, 0, n)
        return np.where(full, or_equal, data[a + step] < data[b + step])

    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    size = np.diff(first, append=len(order))
    base, total = np.repeat(first, size), np.repeat(size, size)
    width = 1
    while len(size) and width < size.max():
        at = np.arange(len(order)) - base  # place in the group
        run = at // width
        low = (run ^ 1) * width  # the other run of the pair
        high = np.minimum(low + width, total)
        todo = np.flatnonzero(low < total)
        mine, left = order[todo], run[todo] % 2 == 0
        lo, hi = low[todo].copy(), high[todo].copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            other = order[base[todo[open_]] + mid]
            # elements of the right run come after equal ones of the left run
            smaller = before(starts[other], starts[mine[open_]], ~left[open_])
            lo[open_] = np.where(smaller, mid + 1, lo[open_])
            hi[open_] = np.where(smaller, hi[open_], mid)
        place = at.copy()
        place[todo] = np.where(left, at[todo] + lo - low[todo], low[todo] + (at[todo] - run[todo] * width) + lo - low[todo])
        merged = np.empty_like(order)
        merged[base + place] = order
        order = merged
        width *= 2
    return order, hashes


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Which suffixes share their first ``most`` bytes with another of their group."""
    out = np.zeros(len(starts), dtype=bool)
    if len(starts) < 2:
        return out
    order, hashes = suffix_sort(data, starts, group, most)
    pair = np.flatnonzero(group[order][1:] == group[order][:-1])
    pair = pair[hashes.common(starts[order[pair]], starts[order[pair + 1]], most) == most]
    wrong: list[np.ndarray] = []
    span = np.arange(most)
    for k in range(0, len(pair), 4000):
        a, b = order[pair[k:k + 4000]], order[pair[k:k + 4000] + 1]
        same = (data[starts[a][:, None] + span] == data[starts[b][:, None] + span]).all(axis=1)
        out[a[same]] = out[b[same]] = True
        if not same.all():
            wrong.append(group[a[~same]])
    for g in np.unique(np.concatenate(wrong)) if wrong else ():
        mine = np.flatnonzero(group == g)
        _, which, count = np.unique(data[starts[mine][:, None] + span].view(f"V{most}").ravel(), return_inverse=True, return_counts=True)
        out[mine] = count[which] > 1
    return out


def cells_of(text: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a text: start of the first window, number of windows, place of
    the anchor in the cell, hash of the anchor."""
    out = []
    width = length - gram + 1  # grams of a window
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, max(0, len(text) - length + 1), _CHUNK):
        part = data[at:at + _CHUNK + length - 1]
        h = PrefixHashes(part).every(gram) * _MIX
        h ^= h >> np.uint64(32)
        h *= _MIX
        least = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        covered = 1
        while 2 * covered <= width:
            least = np.minimum(least[:-covered], least[covered:])
            covered *= 2
        if covered < width:
            least = np.minimum(least[:covered - width], least[width - covered:])
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        out.append((first + at, np.diff(first, append=len(anchor)), anchor[first] - first, h[anchor[first]]))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets (a power of two) of anchor hashes. An anchor is the least hash of
    its window, so its own top bits are nearly always 0: they are mixed anew."""
    if buckets == 1:
        return np.zeros(len(anchor), dtype=np.int64)
    h = anchor * _DEAL
    h ^= h >> np.uint64(32)
    h *= _DEAL
    return (h >> np.uint64(64 - int(math.log2(buckets)))).astype(np.int64)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 4000):
        raw = [t.encode() for t in b.column(1).to_pylist()]
        yield pa.record_batch({"doc_id": b.column(0), "class": pa.array([_digest(x) for x in raw], pa.binary()),
                               "n_bytes": pa.array([len(x) for x in raw], pa.int64()),
                               "sha256": [hashlib.sha256(x).hexdigest() for x in raw]})


def _texts(length: int, seen_limit: int = 500_000):
    """Compressed texts by class; a class goes once per task, as far as the task remembers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, 4000):
            keys, blobs = [], []
            for text in b.column(1).to_pylist():
                raw = text.encode()
                key = _digest(raw) if len(raw) >= length else None
                if key is None or key in seen:
                    continue
                if len(seen) < seen_limit:
                    seen.add(key)
                keys.append(key)
                blobs.append(pack.compress(raw))
            yield pa.record_batch({"class": pa.array(keys, pa.binary()), "kind": pa.array([1] * len(keys), pa.int32()),
                                   "data": pa.array(blobs, pa.binary())})

    return run


def _anchors(length: int, gram: int, buckets: int):
    """Texts -> (bucket, parcel). A parcel: class digests, cells per class (u4), then
    of each cell the anchor hash (8 bytes), start (u4 low, u2 high), windows and anchor place (u1 each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in slices(batches, 6000, max_bytes=4 << 20):
            keys, cells = [], []
            for text in b.column(1).to_pylist():
                raw = text.encode()
                if len(raw) < length:
                    continue
                key = _digest(raw)
                if key not in seen:
                    if len(seen) < 500_000:
                        seen.add(key)
                    keys.append(key)
                    cells.append(cells_of(raw, length, gram))
            if not keys:
                continue
            digests, owner = np.array(keys, dtype="V16"), np.repeat(np.arange(len(keys)), [len(c[0]) for c in cells])
            start, windows, place, anchor = (np.concatenate(x) for x in zip(*cells, strict=True))
            bucket = bucket_of(anchor, buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out_b, out_p = [], []
            for k in range(buckets):
                part = order[ends[k]:ends[k + 1]]
                if len(part):
                    own = owner[part]
                    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    out_b.append(k)
                    out_p.append(b"".join([
                        np.uint32(len(at)).tobytes(), digests[own[at]].tobytes(), np.diff(at, append=len(own)).astype("<u4").tobytes(),
                        anchor[part].astype("<u8").tobytes(), start[part].astype("<u4").tobytes(), (start[part] >> 32).astype("<u2").tobytes(),
                        windows[part].astype("u1").tobytes(), place[part].astype("u1").tobytes()]))
            yield pa.record_batch({"bucket": pa.array(out_b, pa.int32()), "parcel": pa.array(out_p, pa.binary())})

    return run


def _unparcel(blob: bytes):
    m = int(np.frombuffer(blob, "<u4", 1)[0])
    digests, counts = np.frombuffer(blob, "V16", m, 4), np.frombuffer(blob, "<u4", m, 4 + 16 * m)
    k, at = int(counts.sum()), 4 + 20 * m
    start = np.frombuffer(blob, "<u4", k, at + 8 * k).astype(np.int64) | np.frombuffer(blob, "<u2", k, at + 12 * k).astype(np.int64) << 32
    return (digests, counts, np.frombuffer(blob, "<u8", k, at), start,
            np.frombuffer(blob, "u1", k, at + 14 * k), np.frombuffer(blob, "u1", k, at + 15 * k))


def _repeated_anchors(hot_cells: int):
    """One bucket's parcels -> (class, kind 0, cells of repeated anchors: start i8, windows, place, hot u1)."""
    cell = np.dtype([("start", "<i8"), ("windows", "u1"), ("place", "u1"), ("hot", "u1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, parcel in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_bucket.setdefault(bucket, []).append(parcel)
        for parcels in by_bucket.values():
            known: set[bytes] = set()
            parts: list[tuple] = []
            while parcels:
                digests, counts, anchor, *rest = _unparcel(parcels.pop())
                raw = digests.tobytes()
                fresh = np.zeros(len(digests), dtype=bool)
                for i in range(len(digests)):
                    key = raw[16 * i:16 * i + 16]
                    if key not in known:
                        known.add(key)
                        fresh[i] = True
                take = np.repeat(fresh, counts)
                parts.append((digests[fresh], counts[fresh], anchor[take], *(x[take] for x in rest)))
            digests, counts, anchor, *rest = ([p[k] for p in parts] for k in range(6))
            del parts
            anchor = np.concatenate(anchor)
            order = np.argsort(anchor, kind="stable")
            anchor = anchor[order]
            twice = anchor[1:] == anchor[:-1]
            del anchor
            first = np.flatnonzero(np.concatenate([[True], ~twice]))
            size = np.diff(first, append=len(order))
            often = size > 1
            keep, hot = order[np.repeat(often, size)], np.repeat(size[often] > hot_cells, size[often])
            del order, twice, first, size
            by_place = np.argsort(keep, kind="stable")  # cells of a text stand together again
            keep, hot = keep[by_place], hot[by_place]
            cells = np.empty(len(keep), dtype=cell)
            for name in ("start", "windows", "place"):
                cells[name] = np.concatenate(rest.pop(0))[keep]
            cells["hot"] = hot
            digests, counts = np.concatenate(digests), np.concatenate(counts)
            owner = np.searchsorted(np.cumsum(counts, dtype=np.int64), keep, side="right")
            at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
            ends = np.append(at[1:], len(owner))
            for k in range(0, len(at), 2000):
                rows = range(k, min(k + 2000, len(at)))
                yield pa.record_batch({
                    "class": pa.array([digests[owner[at[i]]].tobytes() for i in rows], pa.binary()),
                    "kind": pa.array([0] * len(rows), pa.int32()),
                    "data": pa.array([cells[at[i]:ends[i]].tobytes() for i in rows], pa.binary())})

    run.cell = cell
    return run


def _with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes], bytes]]:
    """Rows sorted by (class, kind) -> (class, data of its kind 0 rows, text), classes with kind 0 rows only."""
    unpack = zstandard.ZstdDecompressor()
    current, rows, done = None, [], False
    for b in batches:
        for key, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != current:
                current, rows, done = key, [], False
            if kind == 0:
                rows.append(data)
            elif rows and not done:
                done = True
                yield key, rows, unpack.decompress(data)


def _cut(length: int, gram: int, cell: np.dtype):
    """Texts with their cells -> a row per cell; its content goes once per task."""
    names = ["anchor", "cell", "class", "start", "windows", "place", "hot", "content"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        out: list[tuple] = []
        for key, blobs, text in _with_texts(batches):
            for start, windows, place, hot in np.frombuffer(b"".join(blobs), dtype=cell).tolist():
                content = text[start:start + windows - 1 + length]
                digest = _digest(content)
                fresh = digest not in seen
                if fresh and len(seen) < 500_000:
                    seen.add(digest)
                anchor = xxhash.xxh3_64_intdigest(content[place:place + gram]) - (1 << 63)
                out.append((anchor, digest, key, start, windows, place, bool(hot), content if fresh else None))
            if len(out) >= 5000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _sort_cells(length: int):
    """Cells sorted by anchor -> (cell, first and last repeated window) by suffix sort within each anchor."""
    def judge(groups: list[dict[bytes, tuple[int, int, bytes]]]) -> pa.RecordBatch | None:
        rows = [(g, digest, *x) for g, cells in enumerate(groups) for digest, x in cells.items()]
        data = np.frombuffer(b"".join(x[4] for x in rows), dtype=np.uint8)
        windows = np.array([x[2] for x in rows])
        base = np.cumsum([0] + [len(x[4]) for x in rows[:-1]])
        which = np.repeat(np.arange(len(rows)), windows)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        # equal windows have their anchor at the same place
        group = np.array([x[0] for x in rows])[which] * 256 + (np.array([x[3] for x in rows])[which] - nth)
        twice = np.flatnonzero(repeated(data, base[which] + nth, group, length))
        if not len(twice):
            return None
        cell, first = np.unique(which[twice], return_index=True)
        last = np.append(first[1:], len(twice)) - 1
        return pa.record_batch({"cell": pa.array([rows[i][1] for i in cell], pa.binary()),
                                "lo": pa.array(nth[twice[first]], pa.int32()), "hi": pa.array(nth[twice[last]], pa.int32())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict[bytes, tuple[int, int, bytes]]] = []
        cells: dict[bytes, tuple[int, int, bytes]] = {}
        current, size = None, 0
        for b in batches:
            for anchor, digest, windows, place, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if anchor != current:
                    if len(cells) > 1:
                        groups.append(cells)
                        size += sum(len(x[2]) for x in cells.values())
                        if size >= _SORT_BYTES:
                            if (found := judge(groups)) is not None:
                                yield found
                            groups, size = [], 0
                    current, cells = anchor, {}
                cells.setdefault(digest, (windows, place, content))
        if len(cells) > 1:
            groups.append(cells)
        if groups and (found := judge(groups)) is not None:
            yield found

    return run


def _hot_windows(length: int, buckets: int):
    """Cells of hot anchors -> (bucket, parcel): digests of all their windows, many to a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                cells, windows, contents = (c.to_pylist() for c in b.slice(at, 2000).columns)
                keys = [xxhash.xxh3_128_digest(x[i:i + length]) for x, n in zip(contents, windows, strict=True) for i in range(n)]
                h = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
                owner = np.repeat(np.arange(len(cells)), windows)
                rows = np.empty(len(h), dtype=_HOT_ROW)
                rows["h1"], rows["h2"], rows["cell"] = h[:, 0], h[:, 1], np.array(cells, dtype="V16")[owner]
                rows["nth"] = np.arange(len(h)) - np.repeat(np.cumsum(windows) - windows, windows)
                bucket = h[:, 0] % np.uint64(buckets)
                for k in np.unique(bucket).tolist():
                    yield pa.record_batch({"bucket": pa.array([k], pa.int32()), "parcel": pa.array([rows[bucket == k].tobytes()], pa.binary())})

    return run


_HOT_ROW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("cell", "V16"), ("nth", "u1")])


def _hot_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket's windows -> (cell, first and last window) of those that two cells or more share."""
    by_bucket: dict[int, list[bytes]] = {}
    for b in batches:
        for bucket, parcel in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_bucket.setdefault(bucket, []).append(parcel)
    for parcels in by_bucket.values():
        rows = np.frombuffer(b"".join(parcels), dtype=_HOT_ROW)
        names, cell = np.unique(rows["cell"], return_inverse=True)
        order = np.lexsort((cell, rows["h2"], rows["h1"]))
        h1, h2, cell, nth = rows["h1"][order], rows["h2"][order], cell[order], rows["nth"][order]
        first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        last = np.append(first[1:], len(order)) - 1
        shared = np.repeat(cell[first] != cell[last], last - first + 1)
        cell, nth = cell[shared], nth[shared]
        order = np.lexsort((nth, cell))
        cell, nth = cell[order], nth[order]
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else cell
        end = np.append(at[1:], len(cell)) - 1
        for k in range(0, len(at), 20_000):
            a, z = at[k:k + 20_000], end[k:k + 20_000]
            yield pa.record_batch({"cell": pa.array([names[i].tobytes() for i in cell[a]], pa.binary()),
                                   "lo": pa.array(nth[a], pa.int32()), "hi": pa.array(nth[z], pa.int32())})


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their spans -> class, removed bytes, maximal runs, digest of the rest."""
    for key, blobs, text in _with_texts(batches):
        spans = np.frombuffer(b"".join(blobs), dtype=">i8").reshape(-1, 2)
        edge = np.zeros(len(text) + 1, dtype=np.int32)
        np.add.at(edge, spans[:, 0].astype(np.int64), 1)
        np.add.at(edge, spans[:, 1].astype(np.int64), -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
        runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        yield pa.record_batch({"class": pa.array([key], pa.binary()), "n_removed": pa.array([len(text) - len(kept)], pa.int64()),
                               "n_spans": pa.array([runs], pa.int64()), "kept_sha256": [hashlib.sha256(kept).hexdigest()],
                               "kept": pa.array([kept], pa.binary())})


def repeated_spans(df: DataFrame, total_bytes: int, id_col: str, text_col: str, length: int = 200, gram: int = 128,
                   hot_cells: int = 4000) -> DataFrame:
    """(class, from, to): byte ranges that repeated strings cover, for each different text (class)."""
    rows = id_and_text(df, id_col, text_col)
    buckets = 1 << max(0, math.ceil(math.log2(max(1, total_bytes * 2 / (length - gram + 2)) / _BUCKET_ANCHORS)))
    anchors = rows.mapInArrow(_anchors(length, gram, buckets), "bucket int, parcel binary").repartitionById(buckets, "bucket")
    find = _repeated_anchors(hot_cells)
    cells = anchors.mapInArrow(find, "class binary, kind int, data binary")
    texts = rows.mapInArrow(_texts(length), "class binary, kind int, data binary")
    both = cells.unionAll(texts).repartition("class").sortWithinPartitions("class", "kind")
    cut = materialize(both.mapInArrow(_cut(length, gram, find.cell), "anchor long, cell binary, class binary, start long, windows int, "
                                      "place int, hot boolean, content binary"), "cells")
    counts = cut.groupBy("cell").agg(F.count("*").alias("n"))
    fresh = cut.filter("content IS NOT NULL")
    sorted_ = fresh.filter("NOT hot").select("anchor", "cell", "windows", "place", "content").repartition("anchor") \
        .sortWithinPartitions("anchor").mapInArrow(_sort_cells(length), "cell binary, lo int, hi int")
    n_hot = fresh.filter("hot").agg(F.sum("windows")).first()[0] or 0
    hot_buckets = 1 + n_hot // _HOT_WINDOWS
    hot = fresh.filter("hot").select("cell", "windows", "content").mapInArrow(
        _hot_windows(length, hot_buckets), "bucket int, parcel binary").repartitionById(hot_buckets, "bucket").mapInArrow(
        _hot_repeats, "cell binary, lo int, hi int")
    found = sorted_.unionAll(hot).groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # written, so that the join below has a shuffle of its own on either side and a hot cell can be split
    verdict = materialize(counts.join(found, "cell", "left").filter("n > 1 OR lo IS NOT NULL"), "verdict")
    all_ = F.col("n") > 1
    lo = F.when(all_, 0).otherwise(F.col("lo"))
    hi = F.when(all_, F.col("windows") - 1).otherwise(F.col("hi"))
    # windows of a cell start less than ``length`` bytes apart, so the bytes between the first and the last are covered
    return cut.select("class", "cell", "start", "windows").join(verdict, "cell").select(
        "class", (F.col("start") + lo).alias("from"), (F.col("start") + hi + length).alias("to"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 128,
          hot_cells: int = 4000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    ``kept``, the remaining bytes (null where nothing is removed)."""
    if not 0 < length - gram < min(200, length):
        raise ValueError("gram must be under length, by less than 200 and less than length")
    rows = id_and_text(df, id_col, text_col)
    docs = materialize(rows.mapInArrow(_docs, "doc_id long, class binary, n_bytes long, sha256 string"), "texts")
    total = docs.agg(F.sum("n_bytes")).first()[0] or 0
    copies = docs.groupBy("class").agg(F.count("*").alias("copies"))
    spans = repeated_spans(df, total, id_col, text_col, length, gram, hot_cells)
    # spans travel as pairs of big-endian longs
    pair = F.unhex(F.concat(F.lpad(F.hex("from"), 16, "0"), F.lpad(F.hex("to"), 16, "0")))
    packed = spans.select("class", F.lit(0).alias("kind"), pair.alias("data"))
    texts = rows.mapInArrow(_texts(length), "class binary, kind int, data binary")
    cut = packed.unionAll(texts).repartition("class").sortWithinPartitions("class", "kind").mapInArrow(
        _apply, "class binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    all_ = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return docs.join(copies, "class").join(cut, "class", "left").select(
        "doc_id", "n_bytes", F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        F.when(all_, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(all_, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"))
