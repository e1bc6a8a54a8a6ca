"""Source divergence: the SQL form on the given tables, and exact integers over awkward rows."""
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from helpers import DOCS, awkward_texts, clashing, rows_of
from stagehand.llm import divergence, queries

COLUMNS = ("lang", "source", "part", "item", "value", "rank")
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def brute(rows, min_docs, top):
    """``rows``: (lang, source, text); Python integers, term by term."""
    n, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", t or "") for a, b, t in rows):
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(TERM, text)]
        groups.add((lang, source))
        n[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in held[lang].items() if d >= min_docs]
        mine = sorted(s for a, s in groups if a == lang)
        every = Counter()
        for s in mine:
            every.update(n[lang, s])

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(n[lang, s]) for s in mine}, share(every)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in mine:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            words = [(f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", words)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(items) if part == "pair" or k < top]
    return sorted(out, key=repr)


def _table(spark, rows):
    return spark.createDataFrame([(k, t, lang, source, None) for k, (lang, source, t) in enumerate(rows)], DOCS)


def _awkward():
    rows = [(lang, f"s{k % 3}" if k % 7 else None, t) for k, (_, t) in enumerate(awkward_texts()) for lang in ("en", None)]
    rows += [("en", "only", ""), ("xx", "a", "rare words here"), ("xx", "b", None), ("", "", "ÄÖ äö Straße STRASSE   z")]
    return rows + [("tie", s, "aa bb cc dd ee ff gg hh ii jj kk ll é z zz") for s in ("p", "p", "q")] + [("tie", "r", "zz zz top")]


@pytest.mark.parametrize(("min_docs", "top"), [(1, 10), (2, 3), (4, 1), (10, 10), (1000, 10)])
def test_equals_exact_integers(spark, min_docs, top):
    rows = _awkward()
    got = rows_of(divergence.audit(clashing(_table(spark, rows)), min_docs=min_docs, top=top), *COLUMNS)
    assert got == brute(rows, min_docs, top)


def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.sql(divergence.oracle()).fetchall(), key=repr)
    assert rows_of(queries.op12_source_divergence(spark, "/root/testdata/sf0.001"), *COLUMNS) == want


def test_counts_beyond_eighteen_digits(spark):
    """Products over 2^63 stay exact."""
    df = spark.sql("SELECT 4611686018427387000L AS n, 4611686018427387000L AS total, 1000L AS v")
    got = df.select(divergence._share(df.n, df.total, df.v)).first()[0]
    assert got == 1 + 10**9 * (4611686018427387000 + 2) // (4611686018427387000 + 2000)


def test_empty_table_and_long_text(spark):
    assert divergence.audit(_table(spark, [])).collect() == []
    rows = [("en", "a", "word " * 500_000), ("en", "b", "other " * 3), ("en", "b", "x" * 2_000_000)]
    assert rows_of(divergence.audit(_table(spark, rows), min_docs=1), *COLUMNS) == brute(rows, 1, 10)
