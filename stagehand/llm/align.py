"""Operator 11: alignment of the tokens of two tokenizers.

Both tokenizers cut the same bytes, so a document has two ascending arrays of
token ends. Byte offsets where both have an end cut the tokens into groups.
They are found by skipping along a diagonal: with the index shift between the
arrays fixed, runs of ever doubled length are compared whole, so a stretch of
tokens that are equal one to one is jumped in logarithmically many comparisons;
where the run breaks, the irregular group is resolved token by token, and the
shift it leaves is that of the next run.

Linked are the token pairs of a group whose bytes overlap: in a run the two
tokens, in an irregular group its staircase. One scan writes, per document, its
figures and its distinct id pairs with their multiplicities, and per task the
number of documents of each pair. Corpus counts of the pairs are a sum over
these. To bring them back to the documents the pairs with the highest counts
(at most ``broadcast_pairs``; a power of two of the count divides them from the
rest) are broadcast, which takes all hot pairs out of the shuffle; only the
rare rest is joined by a shuffle. Documents are never gathered.

Defined results: a null or empty text, or one whose tokens' bytes differ from a
blank and the text, has no tokens: zeros and an empty digest; repeated rows are
documents of their own and count as such; a null id stays null; an empty table
gives no rows; other columns are ignored; very long texts are encoded in parts
that give the same ids and aligned whole, as one row.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagehand.llm.common import id_and_text, slices
from stagehand.llm.tokens import byte_vocabulary, encoder, pieces
from stagehand.session import materialize

#: Distinct pairs of which a task gathers counts before it hands them on.
_GATHER = 2_000_000


@dataclass
class Inner:
    """Tokens that end inside a group, each with the token of the other side that its end lies in.

    Every other token is the last of its side in its group, so these lists tell
    all groups: group g has the tokens after the (g-1)th last one up to the gth."""
    a: list[int] = field(default_factory=list)
    in_b: list[int] = field(default_factory=list)
    b: list[int] = field(default_factory=list)
    in_a: list[int] = field(default_factory=list)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Inner:
    """Groups of two ascending arrays of ends (32 bits) with the same last end."""
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    n_a, n_b = len(list_a), len(list_b)
    out = Inner()
    inner_a, in_b, inner_b, in_a = out.a, out.in_b, out.b, out.in_a
    i = shift = 0
    while i < n_a:
        j = i + shift
        # along the diagonal: ever doubled stretches while they agree, then halved ones up to the first difference
        most, step = min(n_a - i, n_b - j), 4
        while most > 0:
            if step > most:
                step = most
            if raw_a[4 * i:4 * (i + step)] != raw_b[4 * j:4 * (j + step)]:
                break
            i += step
            j += step
            most -= step
            step += step
        else:
            break  # both sides are through
        while step > 1:
            half = step >> 1
            if raw_a[4 * i:4 * (i + half)] == raw_b[4 * j:4 * (j + half)]:
                i += half
                j += half
                step -= half
            else:
                step = half
        # an irregular group: step on the side that is behind until both end together
        x, y = list_a[i], list_b[j]
        while x != y:
            if x < y:
                inner_a.append(i)
                in_b.append(j)
                i += 1
                x = list_a[i]
            else:
                inner_b.append(j)
                in_a.append(i)
                j += 1
                y = list_b[j]
        i += 1
        shift = j + 1 - i
    return out


def _last(n: int, inner: list[int]) -> np.ndarray:
    last = np.ones(n, dtype=bool)
    last[inner] = False
    return last


def links(g: Inner, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the linked tokens: the last ones of each group with each other,
    and every inner token with the one that its end lies in."""
    return (np.concatenate([np.flatnonzero(_last(n_a, g.a)), np.array(g.a + g.in_a, dtype=np.int64)]),
            np.concatenate([np.flatnonzero(_last(n_b, g.b)), np.array(g.in_b + g.b, dtype=np.int64)]))


class _Side:
    """Ids of texts by one tokenizer, the bytes of ids and their decimal forms with a comma or ``mark`` behind."""

    def __init__(self, encode, vocabulary: list[bytes], mark: str):
        self.encode, self.bytes = encode, vocabulary
        self.length = np.array([len(x) for x in vocabulary], dtype=np.int32)
        self.names = [f"{i}{x}" for x in (",", mark) for i in range(len(vocabulary))]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def groups_text(g: Inner, a: np.ndarray, b: np.ndarray, n_left: int, n_right: int, names: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3`` for the decimal ids of both sides; ``names``: those of A and then of B."""
    last_a, last_b = _last(len(a), g.a), _last(len(b), g.b)
    before_a = np.concatenate([[0], np.flatnonzero(last_a) + 1])  # tokens of A up to the start of each group, and all
    before_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    words = np.empty(len(a) + len(b), dtype=np.int64)
    words[np.arange(len(a)) + before_b[group_a]] = a + last_a * n_left
    words[np.arange(len(b)) + before_a[group_b + 1]] = b + last_b * n_right + 2 * n_left
    return "".join(map(names.__getitem__, words.tolist()))[:-1]


_SIDES: dict[tuple[str, str], tuple[_Side, _Side]] = {}


def _sides(path_a: str, path_b: str) -> tuple[_Side, _Side]:
    if (path_a, path_b) not in _SIDES:
        encode, model = encoder(path_a, plain=True), pieces(path_b)
        _SIDES[path_a, path_b] = (_Side(lambda texts: encode([f" {t}" for t in texts]), byte_vocabulary(path_a), "|"),
                                  _Side(model.encode, model.bytes, ";"))
    return _SIDES[path_a, path_b]


def _scan(path_a: str, path_b: str, width: int):
    key_type = pa.int32() if width < 2**31 else pa.int64()
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                        ("keys", pa.list_(key_type)), ("times", pa.list_(pa.int32())), ("key", key_type), ("docs", pa.int64())])
    none = {f.name: f.type for f in schema}

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.record_batch([columns[c] if c in columns else pa.nulls(n, t) for c, t in none.items()], schema=schema)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, docs = np.unique(np.concatenate(held), return_counts=True)
        return batch(len(keys), key=pa.array(keys, key_type), docs=pa.array(docs, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = _sides(path_a, path_b)
        n_right, names = len(right.bytes), left.names + right.names
        row, held, size = TaskContext.get().partitionId() << 40, [], 0
        for b in slices(batches, 4000):
            texts = b.column(1).to_pylist()
            figures, keys, times = [], [], []
            for text, ids_a, ids_b in zip(texts, left.encode(texts), right.encode(texts), strict=True):
                want = f" {text}".encode()
                if not text or left.joined(ids_a) != want or right.joined(ids_b) != want:
                    figures.append((0, 0, 0, 0, ""))
                    keys.append([])
                    times.append([])
                    continue
                a, b_ = np.array(ids_a, dtype=np.int32), np.array(ids_b, dtype=np.int32)
                g = align(np.cumsum(left.length[a], dtype=np.int32), np.cumsum(right.length[b_], dtype=np.int32))
                at_a, at_b = links(g, len(a), len(b_))
                pair, n = np.unique(a[at_a].astype(np.int64) * n_right + b_[at_b], return_counts=True)
                sha = hashlib.sha256(groups_text(g, a, b_, len(left.bytes), n_right, names).encode()).hexdigest()
                figures.append((len(a), len(b_), len(a) - len(g.a), len(at_a), sha))
                keys.append(pair)
                times.append(n)
                held.append(pair)
                size += len(pair)
            n_a, n_b, n_groups, n_links, sha = zip(*figures, strict=True)
            yield batch(len(texts), row=pa.array(np.arange(row, row + len(texts))), doc_id=b.column(0), n_a=pa.array(n_a, pa.int64()),
                        n_b=pa.array(n_b, pa.int64()), n_groups=pa.array(n_groups, pa.int64()), n_links=pa.array(n_links, pa.int64()),
                        groups_sha256=pa.array(sha, pa.string()), keys=_lists(keys, key_type), times=_lists(times, pa.int32()))
            row += len(texts)
            if size > _GATHER:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    name = "int" if key_type == pa.int32() else "long"
    return run, (f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                 f"keys array<{name}>, times array<int>, key {name}, docs long")


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate([np.asarray(v, dtype=np.int64) for v in values]) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat, kind))


def _corpus_counts(scanned: DataFrame, n_right: int) -> DataFrame:
    """(key, docs, best): documents of each id pair; ``best``: the highest of its A id.
    A window holds the pairs of one A id, at most the vocabulary of B."""
    counts = scanned.where("key is not null").groupBy("key").agg(F.sum("docs").alias("docs"))
    of_a = Window.partitionBy(F.expr(f"key div {n_right}"))
    return counts.withColumn("best", (F.col("docs") == F.max("docs").over(of_a)).cast("int"))


def _least_broadcast(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` pairs have that count or a higher one."""
    by_power = counts.groupBy(F.floor(F.log2("docs")).alias("e")).count().orderBy(F.desc("e")).collect()  # 64 rows at most
    seen, least = 0, 2**62
    for power, n in by_power:
        seen += n
        if seen > most:
            break
        least = 2**power
    return least


def align_documents(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    broadcast_pairs: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document.

    ``path_a``: a byte-level ``tokenizers`` file, given a blank and the text;
    ``path_b``: a ``sentencepiece`` model that sets that blank itself.
    """
    n_left, n_right = len(byte_vocabulary(path_a)), len(pieces(path_b).bytes)
    run, schema = _scan(path_a, path_b, n_left * n_right)
    scanned = materialize(id_and_text(df, id_col, text_col).mapInArrow(run, schema), "aligned")
    counts = materialize(_corpus_counts(scanned, n_right), "pair-counts")
    docs = scanned.where("row is not null")
    linked = docs.select("row", F.explode(F.arrays_zip("keys", "times")).alias("l")).select(
        "row", F.col("l.keys").alias("key"), F.col("l.times").alias("times"))
    least = _least_broadcast(counts, broadcast_pairs)
    head = F.broadcast(counts.where(F.col("docs") >= least))
    figures = ["row", (F.col("times") * F.col("docs")).alias("s"), (F.col("times") * F.col("best")).alias("b")]
    found = linked.join(head, "key").select(*figures)
    if not counts.where(F.col("docs") < least).isEmpty():
        rare = linked.join(head, "key", "left_anti").join(counts.where(F.col("docs") < least), "key")
        found = found.unionByName(rare.select(*figures))
    sums = found.groupBy("row").agg(F.sum("s").alias("count_sum"), F.sum("b").alias("n_best"))
    return docs.drop("keys", "times", "key", "docs").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
