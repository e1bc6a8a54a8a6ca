"""Operator 8: quality rules as a short-circuit cascade.

Every document gets the base counts and the base verdict. Documents that pass
the base go through the rules below one after another; a rejected document
skips the rest. The order comes from a sample: each rule's cost (time per
document) and selectivity (share rejected) are measured on the executors and
the rules run by falling rejection per cost. The order changes the work, never
the verdict, since a document is kept only if no rule rejects it.

Defined results: null text has no words and fails the base; ties and repeated
rows are each judged alone; an empty table gives no rows (and the rules keep
the order they are listed in); other columns are ignored; texts of any length
are read whole.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagehand.llm.common import id_and_text, slices

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 8

REPORT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, failed_rule string")

#: Words of abuse that the ``abuse`` rule counts.
ABUSE = frozenset(b"clown disgusting dumb idiot idiots imbecile jerk loser losers moron morons pathetic scum "
                  b"stupid trash ugly vermin worthless".split())


@dataclass
class Doc:
    """One document and its base counts, as the rules see it."""
    raw: bytes
    words: list[bytes]
    word_chars: int
    n_symbols: int
    n_dup_lines: int

    @property
    def n_words(self) -> int:
        return len(self.words)


def _mean_word_length(d: Doc) -> bool:
    return not 2 * d.n_words <= d.word_chars <= 15 * d.n_words


def _symbols(d: Doc) -> bool:
    return 10 * d.n_symbols > d.n_words


def _dup_lines(d: Doc) -> bool:
    return d.n_dup_lines >= 3 and 10 * d.n_dup_lines > 3 * (d.raw.count(b"\n") + 1)


def _shouting(d: Doc) -> bool:
    upper = len(d.raw) - len(d.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(d.raw) - len(d.raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return upper > lower


def _digits(d: Doc) -> bool:
    return 2 * (len(d.raw) - len(d.raw.translate(None, b"0123456789"))) > d.word_chars


def _ellipsis(d: Doc) -> bool:
    lines = d.raw.split(b"\n")
    return 10 * sum(x.rstrip().endswith((b"...", "…".encode())) for x in lines) > 3 * len(lines)


def _few_distinct(d: Doc) -> bool:
    return 100 * len(set(d.words)) < 8 * min(d.n_words, 1000)


def _abuse(d: Doc) -> bool:
    n = sum(w.strip(b".,;:!?\"'()").lower() in ABUSE for w in d.words)
    return n >= 2 and 200 * n > d.n_words


#: name -> does the rule reject the document?
RULES: dict[str, Callable[[Doc], bool]] = {
    "mean_word_length": _mean_word_length, "symbols": _symbols, "dup_lines": _dup_lines, "shouting": _shouting,
    "digits": _digits, "ellipsis": _ellipsis, "few_distinct": _few_distinct, "abuse": _abuse,
}


def repeat_words(docs: list[list[bytes]]) -> np.ndarray:
    """Per document: words inside 8-word windows that occur twice or more in it."""
    sizes = np.array([len(w) for w in docs], dtype=np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros(len(docs), dtype=np.int64)
    if total <= _WINDOW:
        return out
    ids = np.fromiter((hash(w) for words in docs for w in words), dtype=np.int64, count=total).view(np.uint64)
    count = total - _WINDOW + 1
    doc = np.repeat(np.arange(len(docs), dtype=np.uint64), sizes)
    h = doc[:count] * _MIX
    for k in range(_WINDOW):
        h = (h ^ ids[k:count + k]) * _MIX
        h ^= h >> np.uint64(29)
    starts = np.flatnonzero(doc[:count] == doc[_WINDOW - 1:])
    order = starts[np.argsort(h[starts], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    edge = np.zeros(total + 1, dtype=np.int32)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + _WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return inside[ends] - inside[ends - sizes]


def measure(text: str) -> Doc:
    raw = text.encode()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    return Doc(raw, raw.split(), len(text) - spaces, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)))


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


def estimate(rows: DataFrame, sample_rows: int, seed: int = 11) -> list[str]:
    """Rule names by falling rejection per cost, measured on about ``sample_rows`` rows."""
    total = rows.count()
    if not total:
        return list(RULES)
    sample = rows.sample(min(1.0, sample_rows / total), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 0)
        for b in slices(batches, 500):
            docs = [measure(t) for t in b.column(1).to_pylist()]
            docs = [d for d in docs if d.n_words >= 20]
            for name, rule in RULES.items():
                began = time.thread_time_ns()
                rejected[name] += sum(map(rule, docs))
                spent[name] += time.thread_time_ns() - began
        yield pa.record_batch({"rule": list(RULES), "spent": list(spent.values()), "rejected": list(rejected.values())})

    got = (sample.mapInArrow(run, "rule string, spent long, rejected long").groupBy("rule")
           .agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected")).collect())  # a row per rule
    rate = {r.rule: r.rejected / max(1, r.spent) for r in got}
    cost = {r.rule: r.spent for r in got}
    return sorted(RULES, key=lambda name: (-rate.get(name, 0), cost.get(name, 0)))


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """One row per document (schema ``REPORT``). ``failed_rule``: ``base`` or the
    first rule, in the measured order, that rejects the document; null if kept."""
    rows = id_and_text(df, id_col, text_col)
    order = estimate(rows, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            docs = [measure(t) for t in b.column(1).to_pylist()]
            repeats = repeat_words([d.words for d in docs])
            base = [base_fails(d.n_words, int(r)) for d, r in zip(docs, repeats, strict=True)]
            failed: list[str | None] = ["base" if x else None for x in base]
            live = [i for i, x in enumerate(base) if not x]
            for name in order:
                rule, rest = RULES[name], []
                for i in live:
                    if rule(docs[i]):
                        failed[i] = name
                    else:
                        rest.append(i)
                live = rest
            yield pa.record_batch({
                "doc_id": b.column(0), "n_words": [d.n_words for d in docs], "word_chars": [d.word_chars for d in docs],
                "n_symbols": [d.n_symbols for d in docs], "n_dup_lines": [d.n_dup_lines for d in docs],
                "n_repeat_words": repeats, "base_failed": base, "kept": [x is None for x in failed],
                "failed_rule": pa.array(failed, pa.string())})

    return rows.mapInArrow(run, REPORT)
