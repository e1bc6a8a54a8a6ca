"""Log weights, keys and kept rows of whole tables against plain Python, and what the noise does."""
import math
from collections import Counter

from pyspark.sql import functions as F

from helpers import awkward_texts, docs
from stagehand.llm import importance

P = importance.Params(bits=14, n=4)


def _grams(text):
    """Bucket of each n-gram, one byte at a time."""
    raw = f" {text} ".lower().encode() if text else b""
    out = []
    for at in range(len(raw) - P.n + 1):
        h = 0
        for byte in raw[at:at + P.n]:
            h = (h + byte) * 0x9E3779B97F4A7C15 % 2**64
            h ^= h >> 32
        out.append(h >> (64 - P.bits))
    return out


def _brute(rows, labels, noise, share=None):
    """[(id, log weight, key, kept)] in the order of ``rows``."""
    good = {i for i, quality, toxic in labels if i is not None and quality == 1 and not toxic}
    n_good = sum(quality == 1 and not toxic for _, quality, toxic in labels)
    raw, tgt = Counter(), Counter()
    for i, text in rows:
        raw.update(_grams(text))
        if i in good:
            tgt.update(_grams(text))
    n_raw, n_tgt = sum(raw.values()), sum(tgt.values())

    def ratio(gram):
        if not n_tgt:
            return 0.0
        expect = raw[gram] * n_tgt / n_raw
        value = math.log((tgt[gram] + 1) / (expect + 1))
        clear = (tgt[gram] - expect) ** 2 > P.min_z ** 2 * (expect + 1) and abs(value) > math.log(P.min_ratio)
        return value if clear else 0.0

    weights = [sum(map(ratio, g)) / max(1, len(g)) * P.effective_length for g in (_grams(t) for _, t in rows)]
    keys = [w + x for w, x in zip(weights, noise, strict=True)]
    k = math.ceil((n_good / len(labels) if n_good else 1.0) * len(rows)) if share is None else math.ceil(share * len(rows))
    least = sorted(keys, reverse=True)[k - 1] if 0 < k <= len(keys) else -math.inf
    return [(i, w, key, key >= least) for (i, _), w, key in zip(rows, weights, keys, strict=True)]


def _noise(spark, rows):
    unit = (F.pmod(F.xxhash64(F.lit(P.seed), F.col("doc_id"), F.col("text")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    by_row = {(r.doc_id, r.text): r.x for r in docs(spark, rows).select("doc_id", "text", (-F.log(-F.log(unit))).alias("x")).collect()}
    return [by_row[r] for r in rows]


def _corpus():
    rows = [(i, t) for i, t in awkward_texts()]
    for i in range(100, 260):
        words = ("the quiet river ran past old stone mills", "BUY now cheap pills click here win cash")[i % 4 == 3]
        rows.append((i, " ".join([words, str(i * 7919 % 1000)] * (1 + i % 5))))
    labels = [(i, int(i % 4 != 3), int(i % 16 == 0)) for i in range(100, 200)] + [(None, 1, 0), (4, 1, None), (8, None, 0)]
    return rows, labels


def test_whole_table_matches_brute_force(spark):
    rows, labels = _corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    noise = _noise(spark, rows)
    for share in (None, 0.3, 1.0):
        got = importance.classify(docs(spark, rows).repartition(5), marks, keep_share=share, p=P).collect()
        want = _brute(rows, labels, noise, share)
        order = lambda r: (repr(r[0]), round(r[2], 4), r[3])
        assert len(got) == len(want)
        for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
            # the model holds its ratios as floats of 32 bits
            assert a[0] == b[0] and a[3] == b[3] and abs(a[1] - b[1]) < 1e-3 and abs(a[2] - b[2]) < 1e-3


def test_noise_draws_near_the_threshold_only(spark):
    """The sample is a draw: rows near the threshold change with the seed, clear ones do not."""
    rows, labels = _corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    runs = []
    for seed in (1, 2, 3):
        p = importance.Params(bits=P.bits, n=P.n, seed=seed)
        runs.append({(r.doc_id, round(r.log_weight, 6)): r.kept
                     for r in importance.classify(docs(spark, rows), marks, keep_share=0.6, p=p).where("doc_id >= 100").collect()})
    moved = [k for k in runs[0] if len({r[k] for r in runs}) > 1]
    assert 0 < len(moved) < 0.4 * len(runs[0])
    assert not any(runs[0][k] for k in runs[0] if k[0] % 4 == 3 and k not in moved)
