"""Operator 12: how far each source of a language strays from the others and from its language.

A scan counts terms per (lang, source) inside each task and hands on one row per
term, with the number of documents that hold it. One shuffle by (lang, term)
adds these up, finds the terms that enough documents of the language hold, and
writes the kept counts.

Terms of a group that have the same (group count, lang count) have the same
value, so they are one cell with a multiplicity: cells are counted, the
divergence ``f`` is evaluated once per cell, cells of equal value are merged,
and values are ranked by their cumulative multiplicity until ``top`` terms are
reached. Only the cells of those values are expanded to terms, in UTF-8 order.
Two sources of a language are compared by cells of their two counts as well:
tasks form them for the terms that both hold, and hand on one sum a pair of
sources; terms that only one or neither holds follow from the sizes of the
sources' own cells. Hot terms and sources are only ever sums; a row of the pair
step holds the sources of one term, and its result is a row per pair of sources
by contract.

All figures are exact: counts in longs, products in decimals, floors by ``div``.

Defined results: null text, lang and source are ''; repeated rows are documents
of their own; a group without terms, or a language without kept terms, keeps its
pairs (value 0 without kept terms); an empty table gives no rows; other columns
are ignored; long texts are counted whole.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagehand.llm.common import slices, text_or_empty
from stagehand.operators.joins import bounded_broadcast
from stagehand.session import materialize

try:  # the counter behind Counter.update, without its checks
    from collections import _count_elements
except ImportError:  # pragma: no cover
    def _count_elements(counts, items):
        for x in items:
            counts[x] = counts.get(x, 0) + 1

#: Distinct terms that a task holds before it hands on their counts.
_HELD = 500_000
_SCALE = 10**9
#: Lower-cases A-Z and blanks every byte that is in no term; bytes of other characters are over 0x7F.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    """``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased, in UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[dict[bytes, int], dict[bytes, int]]] = {}

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                yield pa.record_batch({"lang": [lang] * len(n), "source": [source] * len(n),
                                       "term": pa.array(list(n), pa.binary()).cast(pa.string()),
                                       "n": pa.array(n.values(), pa.int64()), "docs": pa.array([docs[t] for t in n], pa.int64())})
            else:  # the group itself must not get lost
                yield pa.record_batch({"lang": [lang], "source": [source], "term": pa.array([None], pa.string()),
                                       "n": pa.array([0], pa.int64()), "docs": pa.array([0], pa.int64())})
        held.clear()

    for b in slices(batches, 4000):
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n, docs = held.setdefault((lang, source), ({}, {}))
            words = terms(text)
            _count_elements(n, words)
            _count_elements(docs, set(words))
        if sum(len(n) for n, _ in held.values()) > _HELD:
            yield from hand_on()
    yield from hand_on()


def _share(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * vocabulary)), at most 10^9 + 1."""
    dec = "decimal(38,0)"
    return F.expr("1L") + _div((count + 2).cast("decimal(27,0)") * F.lit(_SCALE).cast("decimal(10,0)"), (total + 2 * vocabulary).cast(dec))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _pair_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the terms that two sources both hold of
    f(x, y) - f(x, 0) - f(0, y) + f(0, 0), f evaluated once per cell of their shares."""
    sums: dict[tuple[str, str, str], int] = {}

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    for b in batches:
        langs = b.column(0).to_numpy(zero_copy_only=False)
        entries = b.column(1)
        offsets = entries.offsets.to_numpy()
        flat = entries.flatten()
        source, p, p0 = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        row = np.repeat(np.arange(len(langs)), np.diff(offsets))
        for lang in dict.fromkeys(langs):
            mine = langs[row] == lang
            names, col = np.unique(source[mine].astype(str), return_inverse=True)
            r, share, none = row[mine], p[mine], p0[mine]
            order = np.argsort(col, kind="stable")
            bounds = np.searchsorted(col[order], np.arange(len(names) + 1))
            lists = [(r[order[s:e]], share[order[s:e]]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            zero = [int(none[order[s]]) for s in bounds[:-1]]
            for i, (rows_a, pa_) in enumerate(lists):
                at = np.full(len(langs), -1, dtype=np.int64)
                at[rows_a] = np.arange(len(rows_a))
                for j in range(i + 1, len(lists)):
                    rows_b, pb = lists[j]
                    hit = at[rows_b]
                    both = hit >= 0
                    if not both.any():
                        continue
                    cells, m = np.unique(pa_[hit[both]] << 30 | pb[both] - 1, return_counts=True)
                    x, y = cells >> 30, (cells & (1 << 30) - 1) + 1
                    a0, b0 = zero[i], zero[j]
                    key = (lang, str(names[i]), str(names[j]))
                    sums[key] = sums.get(key, 0) + int((m * (f(x, y) - f(x, b0) - f(a0, y) + f(a0, b0))).sum())
        if len(sums) > _HELD:
            yield _sums(sums)
            sums = {}
    yield _sums(sums)


def _sums(sums: dict[tuple[str, str, str], int]) -> pa.RecordBatch:
    lang, a, b = zip(*sums, strict=True) if sums else ((), (), ())
    return pa.record_batch({"lang": pa.array(lang, pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
                            "both": pa.array(sums.values(), pa.int64())})


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the other sources of the
    language by divergence; part ``term``: the ``top`` terms that the source uses more
    than its language by what they add to the divergence."""
    rows = df.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("_text"))
    counted = materialize(rows.mapInArrow(_count_terms, _COUNTS), "term-counts")
    group, term = ["lang", "source"], ["lang", "term"]
    of_term = Window.partitionBy(*term)
    kept = (counted.where("term is not null").repartition(*term).groupBy(*group, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .withColumns({"all": F.sum("n").over(of_term), "held": F.sum("docs").over(of_term),
                          "first": F.row_number().over(of_term.orderBy("source")) == 1})
            .where(F.col("held") >= min_docs).select(*group, "term", "n", "all", "first"))
    kept = materialize(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy(*group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
    zero = F.lit(0).cast("long")
    groups = (counted.select(*group).distinct().join(totals, group, "left").join(langs, "lang", "left")
              .select(*group, *[F.coalesce(c, zero).alias(c) for c in ("total", "size", "v", "lang_total")])
              .withColumn("p0", F.when(F.col("v") > 0, _share(zero, F.col("total"), F.col("v"))).otherwise(zero)))
    groups = bounded_broadcast(materialize(groups, "groups"))
    return _pairs(kept, groups).unionByName(_terms(kept, groups, top))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    group = ["lang", "source"]
    p = _share(F.col("n"), F.col("total"), F.col("v"))
    entries = kept.join(groups, group).select("lang", "term", F.struct("source", p.alias("p"), "p0").alias("e"))
    both = (entries.groupBy("lang", "term").agg(F.collect_list("e").alias("e")).select("lang", "e")
            .mapInArrow(_pair_cells, "lang string, a string, b string, both long")
            .groupBy("lang", "a", "b").agg(F.sum("both").alias("both")))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    # the cells of a source against the share that another source gives to terms it lacks
    cells = kept.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("m")).join(groups, group)
    cells = cells.select("lang", F.col("source").alias("a"), p.alias("p"), "m")
    side = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    alone = (cells.join(side, "lang").where("a <> b").groupBy("lang", "a", "b")
             .agg(F.sum(F.col("m") * _f(F.col("p"), F.col("b0"))).alias("alone")))
    one = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("size_a"), F.col("p0").alias("a0"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("size").alias("size_b"), F.col("p0").alias("b0"))
    none = F.when(F.col("v") > 0, (F.col("v") - F.col("size_a") - F.col("size_b")) * _f(F.col("a0"), F.expr("nullif(b0, 0)"))).otherwise(0)
    key = ["lang", "a", "b"]
    value = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("alone", "back", "both")), none)
    pairs = (one.join(two, "lang").where("a <> b").join(alone, key, "left")
             .join(alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("back")), key, "left")
             .join(both, key, "left").select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.cast("long").alias("value")))
    return _ranked(pairs, "pair")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    group, cell = ["lang", "source"], ["lang", "source", "n", "all"]
    counts = kept.groupBy(*cell).agg(F.count(F.lit(1)).alias("m")).join(groups, group)
    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("all"), F.col("lang_total"), F.col("v"))
    cells = counts.select(*cell, "m", p.alias("p"), q.alias("q")).where("p > q").select(*cell, "m", _f(F.col("p"), F.col("q")).alias("value"))
    cells = materialize(cells, "cells")
    best = Window.partitionBy(*group).orderBy(F.desc("value"))
    # equal values merged; of at most ``top`` values a group those that the first ``top`` terms reach
    values = cells.groupBy(*group, "value").agg(F.sum("m").alias("m")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= top)
    values = values.withColumn("before", F.sum("m").over(best) - F.col("m")).where(F.col("before") < top).select(*group, "value")
    chosen = bounded_broadcast(materialize(cells.join(values, [*group, "value"]).select(*cell, "value"), "chosen"))
    return _ranked(kept.join(chosen, cell).select(*group, F.col("term").alias("item"), "value"), "term").where(F.col("rank") <= top)


def oracle(min_docs: int = 10, top: int = 10) -> str:
    """The same rows in SQL, evaluated term by term."""
    share = "1 + 1000000000::hugeint * ({c} + 2) // ({n} + 2 * {v})"
    f = "(p - q) * (p - q) // (p + q)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
vocab AS (SELECT lang, term, count(*)::hugeint AS n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= {min_docs}),
langs AS (SELECT lang, count(*)::hugeint AS v, sum(n)::hugeint AS total FROM vocab GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
held AS (SELECT lang, source, term, count(*)::hugeint AS n FROM words SEMI JOIN vocab USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::hugeint AS total FROM held GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
    {share.format(c="coalesce(h.n, 0)", n="coalesce(t.total, 0)", v="l.v")} AS p, {share.format(c="k.n", n="l.total", v="l.v")} AS q
  FROM groups g JOIN vocab k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source)
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sums AS (SELECT lang, source, item, sum({f}) AS value
  FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source)
  GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::bigint AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, ({f})::bigint FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM parts)
WHERE part = 'pair' OR rank <= {top}"""
