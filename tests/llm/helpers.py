"""Brute-force forms of the operators' contracts and awkward rows, for the tests of this folder."""
import hashlib
import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def awkward_texts():
    """(id, text) with nulls, empties, long texts, ties, repeated rows and repeated ids."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本", "x y", "end.", "A"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = say(120), say(60)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, base), (5, base), (6, base + " tail"), (7, say(3)), (8, "one"), (9, "one"),
            (10, say(30) + "\n" + passage + "\n" + say(30)), (11, say(40) + " " + passage), (12, passage + "\n" + passage),
            (13, "ab" * 400), (14, "\n".join(["Same Line here", "same line HERE ", "short", say(20)])),
            (15, "same line here\nshort\n\n"), (None, "same line here\nof no id " + say(12)), (None, base), (16, say(6000)),
            (17, "é" * 150), (17, "é" * 150), (17, say(50)), (18, "z" * 199), (19, "\x00\x1f  odd \x85 text"), (20, "%%% " * 40)]
    near = base.split()
    for k in range(6):
        other = list(near)
        other[20 * k % 100] = "changed"
        rows.append((30 + k, " ".join(other)))
    return rows


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS)


def clashing(df):
    """The same rows with further columns under names that operators use inside or return."""
    from pyspark.sql import functions as F

    for name in ("_id", "_text", "_row", "id", "class", "kind", "n_words", "kept", "n_bytes", "text_key", "hash", "words", "data"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def shingle_set(text, n=5):
    w = re.findall(WS, lower(text))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_components(rows, percent=80):
    """[(id, set size, component id)] by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return [(doc, len(sets[i]), min(least[find(i)], default=doc) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def removed_strings(rows, length=200):
    """[(id, bytes, removed, runs, digest)] by counting every string of ``length`` bytes."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(kept)))
    return out
