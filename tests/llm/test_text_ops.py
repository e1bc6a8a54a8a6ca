"""Packing (op 9), decontamination (op 10), rules (op 8) and the classifier (op 4)."""
import pickle
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import WS, awkward_texts, clashing, docs, lower, rows_of, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from stagehand.llm import decontaminate, importance, packing, quality_rules, tokens
from stagehand.llm.packing import Limits

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# --- op 9 ----------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 3000)), max_size=60),
       st.sampled_from([Limits(), Limits(64, 3, 64), Limits(1024, 4, 100), Limits(16, 1, 1), Limits(128, 50, 7)]))
def test_every_token_is_packed_once_within_all_limits(items, limits):
    lengths = np.array([max(a, b) for a, b in items], dtype=np.int64)
    losses = np.array([min(a, b) for a, b in items], dtype=np.int64)
    p = packing.pack_window(lengths, losses, limits)
    for i, n in enumerate(lengths):
        spans = sorted((int(s), int(s + k)) for d, s, k, *_ in p if d == i)
        assert [0, *(z for _, z in spans)] == [*(a for a, _ in spans), n] if n else not spans
    for seq in np.unique(p[:, 3]):
        own = p[p[:, 3] == seq]
        own = own[np.argsort(own[:, 4])]
        total = own[:, 2].sum()
        assert (own[:, 4] == np.cumsum(own[:, 2]) - own[:, 2]).all() and (own[:, 2] > 0).all()
        assert total <= limits.tokens and len(own) <= limits.segments and own[:, 5].sum() <= limits.loss
        assert total == limits.tokens or total & (total - 1) == 0
        for i, s, n, _, _, loss in own:
            assert loss == max(0, s + n - max(s, lengths[i] - losses[i]))


def test_documents_round_trip(spark):
    from tokenizers import Tokenizer

    rows = awkward_texts() + [(50, "a<|endoftext|>b <|endoftext|>"), (51, "\u0000 ü😀 \r\n\t  x"), (52, "don't 123 ___ ")]
    got = packing.pack_documents(clashing(docs(spark, rows)).repartition(4), TOKENIZER, window=7).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[i, len(ids)] += 1
        for r in got:
            if r.doc_id == i and r.doc_tokens == len(ids) and sum(1 for j, _ in rows if j == i) == 1:
                assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n * c for (_, n), c in want.items())
    sums = Counter()
    for r in got:
        sums[r.sequence_id] += r.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in sums.values())
    assert packing.pack_documents(docs(spark, []), TOKENIZER).collect() == []


def test_fast_encoder_gives_the_ids_of_the_tokenizer():
    rnd = np.random.default_rng(2)
    texts = ["", " ", "\n\n a", "I'll we've 'S", "<|endoftext|>", "x<|endoftext|>y"] + [t or "" for _, t in awkward_texts()]
    texts += ["".join(chr(c) for c in rnd.integers(1, 0x3000, 200)) for _ in range(200)]
    assert tokens.encoder(TOKENIZER) is not None
    assert tokens.encoder(TOKENIZER)(texts) == tokens._by_tokenizers(TOKENIZER, False)(texts)
    other = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.encoder(other)(["Hello there"]) == tokens._by_tokenizers(other, False)(["Hello there"])


def test_runs_of_millions_of_one_character_are_packed(spark):
    rows = [(1, " " * 2_000_000), (2, "\n" * 2_000_000), (3, "a" * 2_000_000), (4, "x" + " \n" * 700_000 + "y"), (5, "short")]
    ids = tokens._by_tokenizers(TOKENIZER, False)([t for _, t in rows])
    assert tokens.encoder(TOKENIZER)([t for _, t in rows]) == ids
    got = packing.pack_documents(docs(spark, rows), TOKENIZER).collect()
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(i, len(x) + 1) for (i, _), x in zip(rows, ids, strict=True)}
    pieces = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in got}
    whole = [np.array([*x, 0], dtype="<u4") for x in ids]
    assert all(zlib.crc32(whole[doc - 1][start:start + n].tobytes()) == crc for (doc, start), (n, crc) in pieces.items())


def test_examples_with_prompts(spark):
    df = spark.createDataFrame([(1, 30, 10), (2, 100, 100), (3, None, 5), (4, 7, None), (5, 3, 99), (None, 1, 1)], "k long, t int, l int")
    got = packing.pack_examples(df, "k", "t", "l", Limits(64, 2, 40)).collect()
    lengths = Counter()
    for r in got:
        lengths[r.example_id] += r.length
    assert lengths == {1: 30, 2: 100, 4: 7, 5: 3, None: 1}


# --- op 10 ---------------------------------------------------------------------------------

def hits_of(rows, bench, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for k in range(len(w)):
            for m in range(1, n + 1):
                if k + m <= len(w) and tuple(w[k:k + m]) in windows:
                    hit |= set(range(k, k + m))
                    items |= windows[tuple(w[k:k + m])]
        ids = sorted(str(x) for x in items if x is not None)
        out.append((i, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


BENCH = [(7, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (12, "rare-token pair"), (12, "rare-token pair"),
         (3, "one"), (None, "nameless item text"), (9, None), (10, ""), (11, "!!! ..."), (5, "ünï 42 código")]
LEAKS = [(60, "say ALPHA beta, gamma delta epsilon zeta eta theta iota kappa lambda! end"), (61, "beta gamma delta epsilon zeta eta theta iota"),
         (62, "a rare token, PAIR of rare_token pair"), (63, "ÜNÏ ünï 42 código x"), (64, "the nameless\nitem text"), (64, "the nameless\nitem text")]


@pytest.mark.parametrize("block", [32 << 20, 40, 1])
def test_hits_match_brute_force(spark, block):
    rows = awkward_texts() + LEAKS
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.find_hits(clashing(docs(spark, rows)), bench, max_block_bytes=block)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(hits_of(rows, BENCH), key=repr)


@pytest.mark.parametrize("block", [32 << 20, 40])
def test_spans_are_removed(spark, block):
    rows = awkward_texts() + LEAKS
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    df = clashing(docs(spark, rows))
    clean = decontaminate.remove_hits(df, bench, max_block_bytes=block)
    assert clean.columns == df.columns and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[60] == "say ! end" and texts[1] is None and texts[4] == dict(rows)[4]
    assert texts[63] == "ÜNÏ  x" and texts[64] == "the "
    again = decontaminate.find_hits(clean.filter("doc_id >= 60"), bench).filter("contaminated").count()
    assert again == 0
    assert decontaminate.remove_hits(df, bench, max_hit_share=0.5).count() < len(rows)


def test_blocks_are_bounded_by_words(spark):
    bench = [*BENCH, (20, " ".join(f"q{k % 70}" for k in range(150))), (21, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    rows = LEAKS + [(70, " ".join(f"q{k % 70}" for k in range(33, 120))), (71, " ".join(f"q{k}" for k in range(9))), (None, "one")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    blocks = list(decontaminate._blocks(items, "item_id", "text", 10, 60, 32 << 20))
    assert len(blocks) > 3 and all(len(b.words) <= 60 for b, _ in blocks) and [z for _, z in blocks] == [False] * (len(blocks) - 1) + [True]
    got = decontaminate.find_hits(docs(spark, rows), items, max_block_words=60)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(hits_of(rows, bench), key=repr)


def test_a_window_takes_some_tens_of_bytes():
    rnd = np.random.default_rng(6)
    blob = pickle.dumps(decontaminate.WindowSet([(k, [b"w%d" % x for x in rnd.integers(0, 500, 1000)]) for k in range(20)], 10))
    tracemalloc.start()
    held = pickle.loads(blob)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held.windows[10][0].size == 20 * 991 and size / (20 * 991) < 64 and len(blob) / (20 * 991) < 64


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    pieces = [(i, decontaminate.words_of(t or "")) for i, t in BENCH]
    want = [decontaminate.WindowSet(pieces, 10).scan(decontaminate.words_of(t)) for _, t in LEAKS]
    monkeypatch.setattr(decontaminate.WindowSet, "_hash", staticmethod(lambda ids, at, m: np.zeros(len(at), dtype=np.uint64)))
    assert [decontaminate.WindowSet(pieces, 10).scan(decontaminate.words_of(t)) for _, t in LEAKS] == want and want[0][1] == {7}


def test_a_nameless_and_a_numbered_item_in_one_document(spark):
    bench = [*BENCH, (None, "other nameless item")]
    rows = [(1, "one nameless item text, a rare token pair, other nameless item; ünï 42 código"), (2, "nothing")]
    got = decontaminate.find_hits(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), max_block_bytes=1)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(hits_of(rows, bench), key=repr)


def test_empty_benchmark_and_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_hits(docs(spark, awkward_texts()), none)
    assert got.filter("contaminated OR n_items > 0").count() == 0 and got.count() == len(awkward_texts())
    assert decontaminate.find_hits(docs(spark, []), spark.createDataFrame(BENCH, "item_id long, text string")).collect() == []


# --- op 8 ----------------------------------------------------------------------------------

def base_of(text):
    t = text or ""
    w = re.findall(WS, t)
    windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    inside = {j for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(WS, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside),
            len(w) < 20 or 100 * len(inside) > 30 * len(w))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_match_brute_force(spark):
    rows = awkward_texts() + [(70, "a b c d e f g h " * 30), (71, ("l1 x\n" * 4 + "\n \n") * 3), (72, "x " * 8), (73, "#*$%&|<> " * 25)]
    got = quality_rules.apply_rules(clashing(docs(spark, rows)))
    assert rows_of(got, "doc_id", *BASE) == sorted(((i, *base_of(t)) for i, t in rows), key=repr)
    assert got.filter("base_failed AND kept").count() == 0
    assert quality_rules.apply_rules(docs(spark, [])).collect() == []


def test_verdict_is_that_of_all_rules_whatever_the_order(spark, monkeypatch):
    good = " ".join(f"word{i}" for i in range(60))
    bad = {"symbols": good.replace(" ", " | "), "shouting": good.upper(), "abuse": good + " idiot, stupid moron",
           "dup_lines": "\n".join([f"{good} {i}" for i in range(3)] + ["again and again"] * 5),
           "mean_word_length": " ".join(chr(97 + i % 26) for i in range(60)), "digits": " ".join(str(10**9 + i * i) for i in range(50)),
           "ellipsis": "\n".join(f"{good[:60 + i]} and so on..." for i in range(8)),
           "few_distinct": " ".join("abcdefgh"[i * i % 7] * 3 for i in range(300))}
    rows = [(0, good), *((k + 1, t) for k, t in enumerate(bad.values()))]
    verdicts = []
    for order in (list(quality_rules.RULES), list(reversed(quality_rules.RULES))):
        monkeypatch.setattr(quality_rules, "estimate", lambda *a, order=order, **b: order)
        out = {r.doc_id: r for r in quality_rules.apply_rules(docs(spark, rows)).collect()}
        verdicts.append({i: r.kept for i, r in out.items()})
    assert verdicts[0] == verdicts[1] == {i: i == 0 for i in verdicts[0]}


def test_order_is_by_rejection_per_cost(spark):
    rows = [(i, " ".join(f"w{i}x{j} |" for j in range(40))) for i in range(200)]
    order = quality_rules.estimate(docs(spark, rows).selectExpr("doc_id AS _id", "text AS _text"), 200)
    assert order[0] == "symbols" and sorted(order) == sorted(quality_rules.RULES)


# --- op 4 ----------------------------------------------------------------------------------

def corpus():
    rnd = np.random.default_rng(4)
    good = [f"gr{a}o{b}m" for a in range(40) for b in range(5)]
    bad = ["slurp", "grotz", "yuckle"]
    rows, labels = [], []
    for i in range(600):
        words = rnd.choice(good, 80)
        kind = i % 4
        if kind == 3:
            words[rnd.choice(80, 25, replace=False)] = rnd.choice(bad, 25)
        rows.append((i, " ".join(words)))
        if i % 2 or i % 3 == 0:
            labels.append((i, int(kind != 3), int(kind == 3 and i % 8 == 3)))
    return rows, labels


def test_classifier_on_held_out_documents(spark):
    rows, labels = corpus()
    df, marks = clashing(docs(spark, rows)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance.classify(df, marks, keep_share=0.75).collect()}
    held = [i for i, _ in rows if i not in {x for x, _, _ in labels}]
    assert len(got) == 600 and sum(r.kept for r in got.values()) == 450
    right = sum(got[i].kept == (i % 4 != 3) for i in held)
    assert right / len(held) > 0.95
    kept = importance.keep_sample(df, marks, keep_share=0.75)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_the_same_labels_are_drawn_however_they_lie(spark):
    rows, labels = corpus()
    df = docs(spark, rows)
    good = [(i,) for i, quality, toxic in labels if quality == 1 and toxic == 0]
    part = [r.h for r in spark.createDataFrame(good, "i long").selectExpr("pmod(xxhash64(i), 1 << 30) AS h").collect()]
    most = next(m for m in range(20, len(good)) if sum(h < int(m / len(good) * (1 << 30)) for h in part) > m)  # the limit cuts
    p = importance.Params(max_target=most, bits=14, min_z=0.0, min_ratio=1.0)
    one, other = (importance.fit(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int").repartition(n), p)
                  for x, n in ((labels, 1), (labels[::-1], 7)))
    assert (one.log_ratio == other.log_ratio).all()


def test_counts_match_brute_force(spark):
    p = importance.Params(bits=14, n=4)
    texts = ["", "abc", "Abcd ef", "é" * 9, "abcd"]
    got, ends = importance.buckets(texts, p)
    one = [importance.buckets([t], p)[0].tolist() for t in texts]
    assert got.tolist() == sum(one, []) and ends.tolist() == np.cumsum([len(x) for x in one]).tolist()
    assert [len(x) for x in one] == [max(0, len(f" {t} ".encode()) - 3) if t else 0 for t in texts]


def test_gumbel_sample_without_labels_and_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert importance.classify(docs(spark, awkward_texts()), none).filter("kept").count() == len(awkward_texts())
    assert importance.classify(docs(spark, []), none).collect() == []
    odd = spark.createDataFrame([(None, 1, 0), (4, None, None), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = importance.classify(docs(spark, awkward_texts()), odd, keep_share=0.5).collect()
    assert len(got) == len(awkward_texts())
    same = [(r.sample_key, r.kept) for r in got if r.doc_id == 17]
    assert len(set(same)) == 2  # the repeated rows share their fate


@pytest.mark.parametrize("bins", [2, 3, 4096])
def test_kth_largest(spark, bins):
    values = [0.5, 3.0, 3.0, -2.0, 1e9, 7.25, 3.0, -1e-9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, 9):
        assert importance.kth_largest(df, "x", k, bins) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "x", 9) is None
