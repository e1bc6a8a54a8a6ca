"""Operator 7: Jaccard self-join on word n-grams by T-occurrence search.

Documents with equal shingle sets are one class; only classes are compared. A
partner of a class with n shingles shares T = ceil(0.8 n) of them or more, so

1. classes deal their shingles over hash buckets; a bucket keeps the shingles
   that two classes or more hold, with their list lengths;
2. a class with fewer than T shared shingles has no partner and leaves;
3. of the s shared shingles of a class its s - T + 1 with the shortest lists
   must hold one that any partner also has among its own; these prefixes give
   candidate groups (connected components over the prefixes, by stars, never
   by pairs);
4. inside a group every class is searched against the inverted lists with
   DivideSkip: the longest lists are set aside, the short ones are merged and
   counted, classes that reach T less the number of long lists are
   binary-probed in the long ones, and those reaching the overlap are linked.
   Candidates that are already connected are not probed again.

Scale: no pair of documents is shuffled and nothing is collected. Buckets, class
shards and groups are sized by counts; a group over ``group_classes`` classes is
dealt as pairs of blocks, so a task holds two blocks at most. Shingles are 64-bit
hashes (53 bits where lists are compared).

Defined results: null or empty text has an empty set, size 0, and is its own
component; fewer than ``n`` words are one shingle; repeated rows share a class;
a class's id is its smallest non-null id, a null id is never a component's id
unless no member has one; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagehand.llm.common import id_and_text, slices
from stagehand.llm.components import connected_components
from stagehand.session import materialize

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles of a bucket, and of a class shard: bounds the arrays of one task.
_BUCKET_SHINGLES = 4_000_000
#: Bits of a shingle within its bucket.
_LOW = 48


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ ids[j:j + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def class_of(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def least_overlap(size: int, percent: int) -> int:
    """Fewest shingles that a set of ``size`` shares with a partner."""
    return -(-percent * size // 100)


def sets_of(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, class, n_shingles, row_hash) per row; class is null for an empty set."""
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), row_hash(df).alias("_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            got = [shingles(t, n) for t in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "class": pa.array([class_of(h) for h in got], pa.binary()),
                                   "n_shingles": pa.array([len(h) for h in got], pa.int64()), "row_hash": b.column(2)})

    return rows.mapInArrow(run, "doc_id long, class binary, n_shingles long, row_hash long")


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def _group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


# A parcel carries, for many classes, some shingles each: class digests (16 bytes),
# set sizes (u4), counts (u4), then the shingles' low 48 bits (u4, u2), then list lengths (u2) if any.

def _parcel(digests: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, lengths: np.ndarray | None = None) -> bytes:
    parts = [np.uint32(len(digests)).tobytes(), digests.tobytes(), sizes.astype("<u4").tobytes(), counts.astype("<u4").tobytes(),
             (tokens & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), ((tokens >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes()]
    return b"".join(parts + ([np.minimum(lengths, 65535).astype("<u2").tobytes()] if lengths is not None else []))


def _unparcel(blob: bytes, with_lengths: bool):
    m = int(np.frombuffer(blob, "<u4", 1)[0])
    digests = np.frombuffer(blob, "V16", m, 4)
    sizes, counts = np.frombuffer(blob, "<u4", m, 4 + 16 * m), np.frombuffer(blob, "<u4", m, 4 + 20 * m)
    k, at = int(counts.sum()), 4 + 24 * m
    tokens = np.frombuffer(blob, "<u4", k, at).astype(np.uint64) | np.frombuffer(blob, "<u2", k, at + 4 * k).astype(np.uint64) << np.uint64(32)
    return digests, sizes, counts, tokens, np.frombuffer(blob, "<u2", k, at + 6 * k) if with_lengths else None


def _deal(n: int, buckets: int):
    """Texts -> (bucket, parcel). A class goes once per task, as far as the task remembers."""
    bits = np.uint64(64 - int(math.log2(buckets))) if buckets > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in slices(batches, 6000, max_bytes=4 << 20):
            digests, sets = [], []
            for text in b.column(1).to_pylist():
                h = shingles(text, n)
                key = class_of(h)
                if key is not None and key not in seen:
                    if len(seen) < 500_000:
                        seen.add(key)
                    digests.append(key)
                    sets.append(h)
            if not sets:
                continue
            sizes = np.array([len(h) for h in sets])
            keys, tokens = np.array(digests, dtype="V16"), np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            bucket = (tokens >> bits).astype(np.int64) if bits is not None else np.zeros(len(tokens), dtype=np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out_b, out_p = [], []
            for k in range(buckets):
                part = order[ends[k]:ends[k + 1]]
                if len(part):
                    own = owner[part]
                    at = _group_starts(own)
                    who = own[at]
                    out_b.append(k)
                    out_p.append(_parcel(keys[who], sizes[who], np.diff(at, append=len(own)), tokens[part]))
            yield pa.record_batch({"bucket": pa.array(out_b, pa.int32()), "parcel": pa.array(out_p, pa.binary())})

    return run


def _shared(shards: int):
    """One bucket's parcels -> (shard, bucket, parcel) of the shingles that two classes or more hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, parcel in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_bucket.setdefault(bucket, []).append(parcel)
        for bucket, parcels in by_bucket.items():
            numbers: dict[bytes, int] = {}
            all_digests, all_sizes, all_tokens, all_owners = [], [], [], []
            while parcels:
                digests, sizes, counts, tokens, _ = _unparcel(parcels.pop(), False)
                raw = digests.tobytes()
                fresh = np.zeros(len(digests), dtype=bool)
                number = np.zeros(len(digests), dtype=np.int32)
                for i in range(len(digests)):
                    key = raw[16 * i:16 * i + 16]
                    if key not in numbers:
                        numbers[key] = number[i] = len(numbers)
                        fresh[i] = True
                take = np.repeat(fresh, counts)
                all_digests.append(digests[fresh])
                all_sizes.append(sizes[fresh])
                all_tokens.append(tokens[take])
                all_owners.append(np.repeat(number, counts)[take])
            digests, sizes = np.concatenate(all_digests), np.concatenate(all_sizes)
            tokens, owners = np.concatenate(all_tokens), np.concatenate(all_owners)
            del numbers, all_digests, all_sizes, all_tokens, all_owners
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            at = _group_starts(tokens)
            length = np.diff(at, append=len(tokens))
            often = length > 1
            mask = np.repeat(often, length)
            tokens, owners, length = tokens[mask], owners[order[mask]], np.repeat(length[often], length[often])
            del order, mask, at
            if not len(tokens):
                continue
            shard_of = np.frombuffer(digests.tobytes(), "<u8").reshape(-1, 2)[:, 0] % np.uint64(shards)
            by_shard = np.lexsort((owners, shard_of[owners]))
            ends = np.searchsorted(shard_of[owners[by_shard]], np.arange(shards + 1, dtype=np.uint64))
            out_s, out_p = [], []
            for s in range(shards):
                part = by_shard[ends[s]:ends[s + 1]]
                if len(part):
                    own = owners[part]
                    at = _group_starts(own)
                    out_s.append(s)
                    out_p.append(_parcel(digests[own[at]], sizes[own[at]], np.diff(at, append=len(own)), tokens[part], length[part]))
            yield pa.record_batch({"shard": pa.array(out_s, pa.int32()), "bucket": pa.array([bucket] * len(out_s), pa.int32()),
                                   "parcel": pa.array(out_p, pa.binary())})

    return run


def _survivors(percent: int):
    """One shard's parcels -> classes that may have a partner, with their shared
    shingles, shortest lists first, and the length of the prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_rows: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for s, bucket, parcel in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard_rows.setdefault(s, []).append((bucket, parcel))
        for rows in shard_rows.values():
            totals: dict[bytes, int] = {}
            for _, parcel in rows:  # first only the counts, to leave out the hopeless
                digests, _, counts, _, _ = _unparcel(parcel, True)
                raw = digests.tobytes()
                for i, c in enumerate(counts.tolist()):
                    key = raw[16 * i:16 * i + 16]
                    totals[key] = totals.get(key, 0) + c
            found: dict[bytes, tuple[int, list, list]] = {}
            for bucket, parcel in rows:
                digests, sizes, counts, tokens, lengths = _unparcel(parcel, True)
                raw, ends = digests.tobytes(), np.cumsum(counts)
                for i, c in enumerate(counts.tolist()):
                    key, size = raw[16 * i:16 * i + 16], int(sizes[i])
                    if totals[key] >= least_overlap(size, percent):
                        _, t, ln = found.setdefault(key, (size, [], []))
                        part = slice(int(ends[i]) - c, int(ends[i]))
                        t.append(tokens[part] | np.uint64(bucket) << np.uint64(_LOW))
                        ln.append(lengths[part])
            out = []
            for key, (size, t, ln) in found.items():
                tokens, lengths = np.concatenate(t), np.concatenate(ln)
                tokens = tokens[np.lexsort((tokens, lengths))]
                out.append((key, size, len(tokens) - least_overlap(size, percent) + 1, tokens.astype("<u8").tobytes()))
            if out:
                keys, sizes, prefix, blobs = zip(*out, strict=True)
                for at in range(0, len(keys), 500):
                    part = slice(at, at + 500)
                    yield pa.record_batch({"class": pa.array(keys[part], pa.binary()), "size": pa.array(sizes[part], pa.int64()),
                                           "prefix": pa.array(prefix[part], pa.int64()), "tokens": pa.array(blobs[part], pa.binary())})

    return run


def _prefix_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, prefix, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            tokens = np.frombuffer(blob, "<i8", prefix)
            yield pa.record_batch({"token": pa.array(tokens), "class": pa.array([key] * prefix, pa.binary())})


class _Sets:
    """Union-find over the classes of a group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def divide_skip(sizes: np.ndarray, tokens: list[np.ndarray], percent: int) -> list[int]:
    """Root of each set after linking all sets of a group that reach the overlap.

    ``tokens``: the shared tokens of each set. Lists hold set numbers in rising
    order. For each set: its longest lists are set aside (at most T - 1 of
    them), the rest is merged; see the module's text.
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), [len(t) for t in tokens])
    flat = np.concatenate(tokens)
    order = np.lexsort((owner, flat))
    posting, sorted_tokens = owner[order], flat[order]
    at = _group_starts(sorted_tokens)
    ends = np.append(at[1:], len(flat))
    names = sorted_tokens[at]
    sets = _Sets(n)
    for r in range(1, n):
        where = np.searchsorted(names, tokens[r])
        length = ends[where] - at[where]
        where, length = where[length > 1], length[length > 1]
        need = least_overlap(int(sizes[r]), percent)
        if len(where) < need:
            continue
        by_length = np.argsort(length, kind="stable")
        n_long = min(need - 1, int(need / (0.01 * math.log2(max(2, int(length.max()))) + 1)))
        short, long_ = where[by_length[:len(where) - n_long]], where[by_length[len(where) - n_long:]]
        merged = np.concatenate([posting[at[k]:ends[k]] for k in short])
        count = np.bincount(merged[merged < r], minlength=r)
        close = np.flatnonzero((count >= max(1, need - n_long)) & (percent * sizes[r] <= 100 * sizes[:r])
                               & (percent * sizes[:r] <= 100 * sizes[r]))
        if not len(close):
            continue
        close = close[[sets.find(s) != sets.find(r) for s in close.tolist()]]
        overlap = count[close]
        least = -(-percent * (int(sizes[r]) + sizes[close]) // (100 + percent))
        for left, k in zip(range(len(long_), 0, -1), long_, strict=True):  # binary probes
            open_ = overlap + left >= least
            close, overlap, least = close[open_], overlap[open_], least[open_]
            if not len(close):
                break
            own = posting[at[k]:ends[k]]
            overlap = overlap + (own[np.minimum(np.searchsorted(own, close), len(own) - 1)] == close)
        for s in close[overlap >= least].tolist():
            sets.join(r, s)
    return [sets.find(i) for i in range(n)]


def _search(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys, sizes = table["class"].to_pylist(), table["size"].to_numpy()
        order = sorted(range(len(keys)), key=lambda i: (sizes[i], keys[i]))
        tokens = table["tokens"].to_pylist()
        roots = divide_skip(sizes[order], [np.frombuffer(tokens[i], "<u8") for i in order], percent) if len(order) > 1 else [0]
        linked = [(keys[order[i]], keys[order[r]]) for i, r in enumerate(roots) if i != r]
        return pa.table({"u": pa.array([a for a, _ in linked], pa.binary()), "v": pa.array([b for _, b in linked], pa.binary())})

    return run


def class_links(df: DataFrame, n_shingles: int, id_col: str, text_col: str, n: int = 5, percent: int = 80,
                group_classes: int = 4000) -> DataFrame:
    """Links (u, v) between classes that connect exactly the classes connected by
    all links: a forest, not every pair. ``n_shingles``: of all documents together."""
    buckets = 1 << max(0, math.ceil(math.log2(max(1, n_shingles) / _BUCKET_SHINGLES)))
    deal = id_and_text(df, id_col, text_col).mapInArrow(_deal(n, buckets), "bucket int, parcel binary")
    shared = deal.repartitionById(buckets, "bucket").mapInArrow(_shared(buckets), "shard int, bucket int, parcel binary")
    alive = materialize(shared.repartitionById(buckets, "shard").mapInArrow(
        _survivors(percent), "class binary, size long, prefix long, tokens binary"), "join-survivors")
    tokens = alive.select("class", "prefix", "tokens").mapInArrow(_prefix_tokens, "token long, class binary")
    heads = tokens.groupBy("token").agg(F.min("class").alias("head"), F.count("*").alias("n")).filter("n > 1")
    near = tokens.join(heads, "token").filter("class != head").select(F.col("class").alias("u"), F.col("head").alias("v"))
    groups = materialize(connected_components(near), "join-groups")
    blocks = groups.groupBy("root").agg(F.ceil(F.count("*") / group_classes).alias("blocks"))
    members = groups.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = members.select("root", "node", "block", other.alias("other")).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("node").alias("class"))
    work = dealt.join(alive, "class").select("root", "i", "j", "class", "size", "tokens")
    return work.groupBy("root", "i", "j").applyInArrow(_search(percent), "u binary, v binary")


def _rooted(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``sets_of`` and, for each class, its component's root class and smallest id."""
    docs = materialize(sets_of(df, id_col, text_col, n), "join-sets")
    total = docs.agg(F.sum("n_shingles")).first()[0] or 0
    roots = materialize(connected_components(class_links(df, total, id_col, text_col, n, percent)), "join-components")
    classes = docs.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = materialize(classes.join(roots, classes["class"] == roots["node"], "left").select(
        "class", "least", F.coalesce("root", "class").alias("root")), "join-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs, rooted.join(ids, "root").select("class", "root", "component_id")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and ``class``
    (equal for equal shingle sets, null for an empty set)."""
    docs, named = _rooted(df, id_col, text_col, n, percent)
    return docs.join(named, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, with one row of each component: the one with the
    smallest id (null last), then the smallest hash of its columns. Documents
    with an empty set are linked with nothing and all stay."""
    docs, named = _rooted(df, id_col, text_col, n, percent)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row_hash")
    first = docs.join(named.select("class", "root"), "class").groupBy("root").agg(F.min(order).alias("o"))
    keep = first.select("o.no_id", "o.id", F.col("o.row_hash").alias("hash"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).isNull().alias("no_id"),
                     F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), row_hash(df).alias("hash"),
                     F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("words"))
    # equal rows share a key: the join has dealt them by it, so one of each is taken without a further shuffle
    chosen = rows.filter("words").join(keep, ["no_id", "id", "hash"]).dropDuplicates(["no_id", "id", "hash"])
    out = chosen.select("_row").unionAll(rows.filter("NOT words").select("_row"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
