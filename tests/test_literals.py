"""List-literal cells parsed natively (F10, D15); malformed cells give nothing."""
from stagehand.functions import parse_pair_list, parse_string_list, link_type_map, LINK_COLUMN_TO_TYPE
from pyspark.sql import functions as F

CELLS = [
    ("ok", "[('771', 'Heist'), ('88', 'Sailing, (with) commas')]"),
    ("dq", "[(\"7\", \"Tom's Game\")]"),
    ("esc", "[('12', 'It\\'s \\\\ fine')]"),
    ("bare", "[(12, 'x')]"),
    ("trail", "[('1', 'a'),]"),
    ("three", "[('1', 'a', 'b')]"),
    ("open", "[('1', 'a')"),
    ("junk", "[('1', 'a')] extra"),
    ("empty", "[]"),
    ("blank", ""),
    ("null", None),
]


def _parse(spark):
    df = spark.createDataFrame(CELLS, "k string, c string")
    return {r.k: [(p.ref_id, p.value) for p in r.p] for r in df.select("k", parse_pair_list("c").alias("p")).collect()}


def test_pairs(spark):
    got = _parse(spark)
    assert got["ok"] == [("771", "Heist"), ("88", "Sailing, (with) commas")]
    assert got["dq"] == [("7", "Tom's Game")]
    assert got["esc"] == [("12", "It's \\ fine")]
    assert got["bare"] == [("12", "x")]
    assert got["trail"] == [("1", "a")]


def test_malformed_and_blank_give_empty(spark):
    got = _parse(spark)
    for k in ("three", "open", "junk", "empty", "blank", "null"):
        assert got[k] == [], k


def test_string_list(spark):
    df = spark.createDataFrame([("['Strategy Game Rank', 'Family Game Rank']",), ("['a'",), (None,)], "c string")
    got = [r[0] for r in df.select(parse_string_list("c")).collect()]
    assert got == [["Strategy Game Rank", "Family Game Rank"], [], []]


def test_link_type_map(spark):
    df = spark.createDataFrame([(k,) for k in LINK_COLUMN_TO_TYPE], "c string")
    got = [r[0] for r in df.select(F.element_at(link_type_map(), F.col("c"))).collect()]
    assert got == list(LINK_COLUMN_TO_TYPE.values())
    assert len(LINK_COLUMN_TO_TYPE) == 9


def test_cells_match_the_python_parser(spark):
    import ast
    import random
    import warnings

    from stagehand.functions.literals import parse_pair_list, parse_string_list
    rnd = random.Random(8)
    letters = "ab'\"\\\n\r\t\x07\x0b\x00\x7f\xa0\xe9\u200b\U0001f600,()[] "
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(9)))
    cells = [f([(word(), word()) for _ in range(rnd.randrange(5))]) for _ in range(150) for f in (repr, ascii)]
    cells += [repr([(str(i), "v" * 5) for i in range(5000)]), repr([("1", "x" * 100_000)]), repr([("1", "it's \\ " * 20_000)])]
    cells += [r"[('1', '\101\x41\u0041\U00000041\q')]", r"[('1', '\1234')]", "[('1', 'a\nb')]", "[('1',)]", "[(1, 2, 3)]", "[('1', 'a'),]",
              "[(1, u'x')]", r"[('1', '\x4')]", r"[('1', '\U00110000')]", "[]", " [ ] ", "", "x", None, "[('1', 'a')", "[('1', 'a')] x"]
    want = {}
    for i, c in enumerate(cells):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                want[i] = [(str(a), str(b)) for a, b in ast.literal_eval(c)]
        except Exception:  # noqa: BLE001
            want[i] = []
    df = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    got = {r.i: [(p.ref_id, p.value) for p in r.p] for r in df.select("i", parse_pair_list("c").alias("p")).collect()}
    assert got == want
    names = ["a" * 50_000, "it's", 'say "x"', "line\nbreak", "\xa0"] * 300
    one = spark.createDataFrame([(repr(names),), (repr(names)[:-1],)], "c string").select(parse_string_list("c").alias("l")).collect()
    assert [r.l for r in one] == [names, []]
