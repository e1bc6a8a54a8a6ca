"""Archives (op 2), shards (op 6) and main text (op 5)."""
import base64
import hashlib
import io
import itertools
import random
import struct
import zipfile

import duckdb
import pyarrow as pa
import pytest
from helpers import awkward_texts, clashing, docs, rows_of

from stagehand.llm import extract, sharding, warc
from stagehand.session import scratch_path

PAGES = "page_id long, url string, html string"


# --- op 2 ----------------------------------------------------------------------------------

ROWS = [(1, "http://a/x", "<p>same</p>"), (5, "http://b/y z\r\nEvil: 1", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://c", None),
        (7, "http://d", ""), (9, "ü", "é" * 3000), (9, "ü", "é" * 3000), (None, "n", "<p>same</p>"), (None, None, "alone"), (-2, "m", "WARC/1.1\r\n\r\nx")]


def want_records(rows, least=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = len(b) >= least and top is not None and i != top
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 12])
def test_pages_come_back(spark, least):
    df = clashing(spark.createDataFrame(ROWS, PAGES))
    got = warc.round_trip(df, revisit_min_bytes=least)
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want_records(ROWS, least)
    payloads = {bytes(r.payload) for r in got.filter("record_type = 'response'").collect()}
    assert payloads == {(h or "").encode() for _, _, h in ROWS}
    assert "http://b/y%20z%0D%0AEvil:%201" in {r.target_uri for r in got.collect()}


def test_many_archives_and_none(spark):
    rows = [(i, f"u{i}", f"<p>{'x' * i}</p>") for i in range(200)]
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES), folder, max_archive_bytes=3000)
    assert manifest.count() > 3 and manifest.agg({"n_records": "sum"}).first()[0] == 200
    assert rows_of(warc.read_archives(manifest), "page_id", "payload_bytes") == sorted(((i, len(h)) for i, _, h in rows), key=repr)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def reader(data):
    return lambda at, n: data[at:at + n]


def zip64_by_hand(data, name=b"archive/data.warc.gz"):
    """A ZIP file whose sizes, offsets and counts are all in the ZIP64 fields, behind some leading bytes."""
    lead = b"prefix that is no member"
    local = b"PK\x03\x04" + struct.pack("<5H3L2H", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<2H2Q", 1, 16, len(data), len(data))
    extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), len(lead))
    central = b"PK\x01\x02" + struct.pack("<6H3L5H2L", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(lead) + len(local) + len(data)
    end64 = b"PK\x06\x06" + struct.pack("<Q2H2L4Q", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = b"PK\x06\x07" + struct.pack("<LQL", 0, at + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<4H2LH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment"
    return lead + local + data + central + end64 + locator + end


def test_zip_directories():
    blob = zip64_by_hand(b"stored bytes")
    (m,) = warc.read_directory(reader(blob), len(blob))
    at = warc.data_offset(reader(blob), m)
    assert (m.name, m.size, blob[at:at + m.size]) == ("archive/data.warc.gz", 12, b"stored bytes")
    for force in (False, True):
        packed = warc.pack_archive([b"abc", b"de"], ["x\n"], force_zip64=force)
        got = {m.name: packed[(a := warc.data_offset(reader(packed), m)):a + m.size] for m in warc.read_directory(reader(packed), len(packed))}
        assert got == {warc.RECORDS: b"abcde", warc.INDEX: b"x\n"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    (m,) = warc.read_directory(reader(out.getvalue()), len(out.getvalue()))
    with pytest.raises(ValueError, match="compressed"):
        warc.data_offset(reader(out.getvalue()), m)
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.read_directory(reader(b"nothing"), 7)


def test_member_without_an_index_is_streamed(tmp_path):
    import gzip

    records = [gzip.compress(warc.encode_record(i, "u", b"p" * i, None)) for i in range(20)]
    path = tmp_path / "a.wacz"
    path.write_bytes(zip64_by_hand(b"".join(records)))
    spans = list(warc.locate(iter([pa.record_batch({"path": [str(path)]})])))
    assert sum(s.num_rows for s in spans) == 1
    got = [x for b in warc.fetch(iter(spans)) for x in b.column(0).to_pylist()]
    assert got == list(range(20))


def test_a_package_of_another_writer(tmp_path):
    """Two record members, real CDXJ lines packed by gzip, a deflated second index, other record types, a member without lines."""
    import gzip
    import json

    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nsoft\r\n\r\n"
    foreign = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI: http://x/\r\nContent-Length: 31\r\n\r\n"
               b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello\n\r\n\r\n")
    files, lines = {}, {}
    for name, raws in (("a.warc.gz", [info, warc.encode_record(1, "u", b"one", None), warc.encode_record(2, "u", b"two", None)]),
                       ("b.warc.gz", [warc.encode_record(3, "v", b"three" * 500, None), foreign]), ("c.warc.gz", [warc.encode_record(9, "w", b"", None)])):
        files[name], lines[name] = b"", []
        for raw in raws:
            packed = gzip.compress(raw)
            lines[name].append("com,example)/p 20240102030405 " + json.dumps({"url": "u", "mime": "text/html", "status": "200", "length": str(len(packed)),
                                                                              "offset": str(len(files[name])), "filename": name}) + "\n")
            files[name] += packed
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        for name, data in files.items():
            z.writestr(f"archive/{name}", data)
        z.writestr("indexes/index.cdx.gz", gzip.compress(('!meta 0 {"format": "cdxj"}\n' + "".join(lines["b.warc.gz"][::-1])).encode()))
        z.writestr(zipfile.ZipInfo("indexes/more.cdxj"), "".join(lines["a.warc.gz"][1:]), zipfile.ZIP_DEFLATED)
    spans = list(warc.locate(iter([pa.record_batch({"path": [str(path)]})])))
    assert [s.num_rows for s in spans] == [2, 2, 1]
    got = [r for b in warc.fetch(iter(spans)) for r in b.to_pylist()]
    assert [(r["page_id"], r["record_type"], r["payload"]) for r in got] == [
        (1, "response", b"one"), (2, "response", b"two"), (3, "response", b"three" * 500), (None, "response", b"hello\n"), (9, "response", b"")]
    assert got[3]["payload_digest"] == warc.payload_digest(b"hello\n") and warc.decode_record(info).record_type == "warcinfo"
    with pytest.raises(ValueError, match="digest"):
        warc.decode_record(warc.encode_record(1, "u", b"x", None).replace(b"\r\n\r\nx", b"\r\n\r\ny"))


def test_damaged_records_are_refused():
    raw = warc.encode_record(1, "u", b"payload", None)
    for bad in (raw[:-8], raw.replace(b"payload", b"pay1oad"), b"no record"):
        with pytest.raises(ValueError):
            warc.decode_record(bad)


# --- op 6 ----------------------------------------------------------------------------------

@pytest.mark.parametrize("limit,round_bits", [(1, 12), (700, 3), (5000, 2), (10**9, 12)])
def test_shards_match_sql(spark, limit, round_bits):
    rows = awkward_texts() + [(i, "t" * (i % 50)) for i in range(100, 400)]
    df = docs(spark, rows)
    got = sharding.assign(clashing(df), limit, round_bits=round_bits)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.execute(sharding.oracle(limit, 59)).fetchall()
    assert rows_of(got, "doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_docs", "fits") == sorted(want, key=repr)
    for r in got.filter("NOT fits").collect():  # one row, or equal rows
        assert r.shard_docs <= 2 and r.shard_bytes > limit
    assert sharding.assign(docs(spark, []), limit).collect() == []


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(i, "x" * 40) for i in range(300)] + [(7, "x" * 40)]
    directory = sharding.write_shards(docs(spark, rows), str(tmp_path / "s"), 1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 301 and set(docs(spark, rows).columns) < set(back.columns)
    sizes = {r._shard[1:]: r["count"] * 40 for r in back.groupBy("_shard").count().collect()}
    assert sizes == {r.shard: r.shard_bytes for r in directory.collect()} and max(sizes.values()) <= 1000


# --- op 5 ----------------------------------------------------------------------------------

ARTICLE = """<article><h1>A &lt;title&gt; of it</h1><p><b>First   paragraph
 of the text &amp; more,<br>with a <a href="/x">link</a> in it.</b><p>Second one, unclosed, which goes on for some while.
<ul><li>point one<li>point two</ul><blockquote>Someone said this at length, and it matters.</blockquote>
<table><tr><td>cell a<td>cell b</table></article>"""
TEXT = ("A <title> of it\nFirst paragraph of the text & more, with a link in it.\nSecond one, unclosed, which goes on for some while.\n"
        "point one\npoint two\nSomeone said this at length, and it matters.\ncell a\ncell b")
AROUND = ["<nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav>", "<header><h2>The Site</h2></header>",
          "<div class='cookie-notice'><p>We use cookies to make this site better for you. Accept?</p></div>",
          "<aside><p>Related stories that you may want to read next, perhaps today.</p></aside>",
          "<form><label>Mail</label><input name=a><button>Send</button></form>", "<div class=\"ad\">Buy these shoes, now cheaper than ever before.</div>",
          "<script>if (a < b) { document.write('<p>no</p>') }</script><style>p { x: '</p>' }</style><!-- <p>hidden</p> -->",
          "<section id=comments><h3>2 comments</h3><div class=comment><p>What a wonderful article, thank you so much for writing it!</p></div></section>",
          "<div class='sidebarLeft'><p>Popular: ten things that you never knew about the thing.</p></div>", "<footer>&copy; 2020 The Site</footer>"]


@pytest.mark.parametrize("seed", range(12))
def test_article_is_separated(seed):
    rnd = random.Random(seed)
    parts = rnd.sample(AROUND, rnd.randrange(1, len(AROUND) + 1))
    k = rnd.randrange(len(parts) + 1)
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join([*parts[:k], ARTICLE, *parts[k:]])
    assert extract.main_text(page)[0] == TEXT


def test_article_in_plain_divisions():
    page = "<body><div id=top-nav><a>A</a> <a>B</a></div><div class=post-content>" + ARTICLE.replace("article>", "div>") + "".join(AROUND) + "</div>"
    assert extract.main_text(page)[0] == TEXT


def test_inside_boilerplate_of_an_article():
    page = ARTICLE.replace("</article>", "<div class=share-buttons><a>Tweet</a></div><form><p>Subscribe to us</p></form></article>")
    assert extract.main_text(page)[0] == TEXT


SAID = ["This is paragraph %d of the story, which goes on for a good while and says quite a bit about things." % k for k in range(5)]
STORY = "".join(f"<p>{p}</p>" for p in SAID)


@pytest.mark.parametrize("page", [
    f"<div class='content-sidebar-wrap'>{STORY}</div>", f"<article class='post tag-social'>{STORY}</article>",
    f"<article><div class='share-price-table'>{STORY}</div></article>", f"<div id='sidebar'>{STORY}</div>",
    f"<div class='post comments-open'>{STORY}</div><div class='comments'><p>Nice read, thanks a lot for this long article, I liked it.</p></div>",
    f"<div class='story'>{STORY}</div><div class='comment-list'>" + "<p>I do not agree with this, says a reader at length.</p>" * 20 + "</div>",
    f"<div id='main'>{STORY}</div><div class='sidebar-left'><ul><li>one thing</li><li>another thing here</li></ul></div>",
    f"<div class='cookie-banner'><p>We use cookies to improve this site, please accept them now.</p></div><div class='entry'>{STORY}</div>",
    f"<main>{STORY}<div class='related-posts'><p>Another story that you may like, told in one sentence.</p></div></main>",
    f"<div class='entry-header'><h1>A headline of the story</h1></div><div class='widget'>{STORY}</div>"])
def test_names_of_containers(page):
    """No article is lost by a word in a class, and no page part stays by one."""
    got = extract.main_text(f"<body><nav><a href=/>Home</a></nav>{page}<footer>&copy; Site</footer></body>")[0]
    assert got.removeprefix("A headline of the story\n") == "\n".join(SAID)


def test_formulas_stay():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be a number of some note.</p></article>"
    assert extract.main_text(page)[0] == "Let x=2 be a number of some note."


@pytest.mark.parametrize("mark", ["<![CDATA[", "<!", "<a '", "<div class='sidebar'>", "<script>x", "<b>", " <", "</", "</i>", "<b></i>"])
def test_time_for_markers_that_never_close(mark):
    import time

    start = time.thread_time()
    extract.main_text("<div><b><p>hello</p>" + mark * (2_000_000 // len(mark)) + ">")
    assert time.thread_time() - start < 20


def test_min_cut_is_minimal():
    rnd = random.Random(1)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        keep, drop = [rnd.random() * 5 for _ in range(n)], [rnd.random() * 5 for _ in range(n)]
        edges = [(a, b, rnd.random() * 3) for a in range(n) for b in range(a) if rnd.random() < 0.5]

        def cost(lab):
            return sum(d if x else k for k, d, x in zip(keep, drop, lab, strict=True)) + sum(w for a, b, w in edges if lab[a] != lab[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(extract.min_cut(keep, drop, edges)) == pytest.approx(best)


def test_odd_pages(spark):
    deep = "<div>" * 20_000 + "<p>a text that is deep down in the page, and long enough</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>x &nbsp; y&#33;</p"), (3, "u", "<p>x &nbsp; y&#33;</p"), (None, "u", "<<<>>> <p>a < b</p>"),
            (4, "u", "<script>never closed <p>no</p>"), (5, "u", deep), (6, "u", "<p>" + "word " * 50_000 + "</p>"), (7, "u", "<!-- open <p>x</p>"),
            (8, "u", "<a " * 2000), (9, "u", "</p></div></b>stray ends, then a text of its own.")]
    got = {r.page_id: r for r in extract.extract(clashing(spark.createDataFrame(rows, PAGES))).collect()}
    assert got[1].text == got[2].text == got[4].text == got[7].text == "" and got[1].n_chars == 0 and got[2].url is None
    assert got[5].text == "a text that is deep down in the page, and long enough"
    assert got[6].n_chars == 50_000 * 5 - 1 and got[3].text == "x y!" and got[8].text == ""
    assert got[9].text == "stray ends, then a text of its own."
    assert extract.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_test_pages_give_their_article(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"<br[^>]*>", " ", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1])
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x)
