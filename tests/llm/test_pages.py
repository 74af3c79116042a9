"""HTML extraction and WARC packages."""

import hashlib
import html
import io
import random
import re
import struct
import zipfile

import duckdb
import pytest

from larkspur.llm import html_extract as H
from larkspur.llm import warc_zip as W
from larkspur.llm.catalogue import ORACLES, QUERIES

PAGE = """<html><head><title>x</title></head><body><header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><a href=/>Home</a></nav>
<div class="wrap"><div class="post-123 content"><h2>Title &amp; more</h2><p>One <b>bold</b> text
 here &eacute;.<p>Two <a href=x>link</a> text, long long long long long<ul><li>a<li>b</ul><div class="ad-slot">BUY</div><aside>side</aside>
<table><tr><td>c1<td>c2</table><form><input>Sub<button>go</button></form></div><div class="sidebar"><p>popular posts</p></div></div>
<section class="comments"><h3>Comments</h3><p>great post friend</p></section><footer>foot</footer></body></html>"""
TEXT = "Title & more\nOne bold text here é.\nTwo link text, long long long long long\na\nb\nc1\nc2"


def test_article_without_its_surroundings():
    path, _ = H.vote(PAGE)
    assert path == ">html>body>div.wrap>div.content.post-#"
    assert H.extract_page(PAGE, None) == TEXT == H.extract_page(PAGE, [">nowhere", path])


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text <p>a<p>b", "just text\na\nb"), ("<p>a < b & c <!-- x", "a < b & c"), ("<div hidden>x</div><p>y<script>if(a<b)</p>", "y"),
    ("<p>a<br>b &nbsp; c</p>", "a b c"), ("<article><p>x &lt;p&gt; y</p></article>", "x <p> y"), ("<style>p{}</style><p>q", "q"), ("<p a='>'>t</p>", "t"),
    ("<article><p>one<aside>no</aside><p>two</article>", "one\ntwo"), ("<nav>only</nav>", ""), ("<main><h1>T</h1>tail</main>", "T\ntail"),
])
def test_small_pages(page, text):
    assert H.extract_page(page, None) == text


def test_long_broken_page_is_fast():
    assert H.extract_page("<a <b \"" * 50_000 + "<div>" * 2_000 + "<p>x", None).endswith("x")


def test_deep_page_needs_no_long_paths():
    page = H.Page("<div class=a1>x" * 50_000 + "</section>" * 50_000 + "<article>end")
    assert sum(len(n.step) for n in page.nodes) < 400_000 and page.nodes[1].total == 50_003
    path = page.path(3)
    assert path == ">div.a#" * 3 and page.at_path(path) == 3


def test_query_equals_the_marked_article(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op3_html_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_hosts_vote(spark):
    good = '<body><div class="c1"><div class="x9"><p>%s</p></div><div class="y"><p>short</p></div></div></body>'
    odd = '<body><div class="c1"><div class="x8"><p>tiny</p></div><div class="y"><p>a much longer text than the other one here</p></div></div></body>'
    rows = [(i, "http://h.example/%d" % i, good % ("long text of the page " * 9)) for i in range(9)] + [(9, "http://h.example/9", odd), (10, None, "<p>lone</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = {r.host: r.paths for r in H.winning_paths(df).collect()}
    assert paths["h.example"][0] == ">body>div.c#>div.x#"
    out = {r.page_id: r.text for r in H.extract(df).collect()}
    assert out[9] == "tiny" and out[10] == "lone"


def test_warc_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = sorted(map(str, con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLES['op8_warc']})").fetchall()))
    rows = QUERIES["op8_warc"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in rows) == want


def test_revisits_and_short_payloads(spark, tmp_path):
    big, small = "x" * 200 + "é", "y" * 99
    rows = [(5, big), (3, big), (9, big), (3, big), (1, small), (2, small), (4, None), (None, big), (6, "z" * 100), (7, "z" * 100)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    manifest = W.write_archives(df, f"file://{tmp_path}/a", url_col=None)
    back = W.read_archives(manifest, with_payload=True).collect()
    got = sorted((str(r.id), r.record_type, str(r.refers_to), r.payload_bytes) for r in back)
    want = [("5", "revisit", "3", 202), ("3", "response", "None", 202), ("9", "revisit", "3", 202), ("3", "response", "None", 202), ("1", "response", "None", 99), ("2", "response", "None", 99), ("4", "response", "None", 0), ("None", "revisit", "3", 202), ("6", "response", "None", 100), ("7", "revisit", "6", 100)]
    assert got == sorted(want)
    texts = {r.id: r.payload for r in back if r.record_type == "response"}
    assert texts["3"].decode() == big and texts["4"] == b"" and all(r.payload is None for r in back if r.record_type == "revisit")
    assert all(r.payload_digest == hashlib.sha256((big if r.payload_bytes == 202 else small if r.payload_bytes == 99 else "z" * r.payload_bytes).encode()).hexdigest() for r in back)


def test_records_round_trip():
    r = random.Random(1)
    for _ in range(200):
        payload = bytes(r.randrange(256) for _ in range(r.randint(0, 300)))
        digest = hashlib.sha256(payload).hexdigest()
        read = W.parse_record(W.record("response", "7", "http://a/\r\nb c", payload, digest, None))
        assert (read.payload, read.digest, read.page, read.url) == (payload, digest, "7", "http://a/%0D%0Ab%20c")
    with pytest.raises(ValueError):
        W.parse_record(W.record("response", "7", None, b"abc", hashlib.sha256(b"abd").hexdigest(), None))


def package(path, n=20):
    p = W.Package(str(path))
    for i in range(n):
        body = (b"%d " % i) * 50
        p.add(W.record("response", str(i), None, body, hashlib.sha256(body).hexdigest(), None), page=str(i))
    return p.close()


def test_reader_agrees_with_the_library_and_reads_ranges(tmp_path):
    uri, n, size = package(tmp_path / "p.zip")
    reader = W.ZipReader(uri)
    with zipfile.ZipFile(uri) as z:
        assert {m.name: (m.size, m.method) for m in reader.members.values()} == {i.filename: (i.file_size, 0) for i in z.infolist()}
        member = reader.members[W.ARCHIVE]
        assert reader.read(reader.start(member), member.size) == z.read(W.ARCHIVE)
    index = reader.index()
    assert len(index) == n and [r.page for r in reader.records(block=1)] == [r.page for r in reader.records()] == [str(i) for i in range(20)]
    assert [r.page for r in reader.records([index[7], index[3], index[4]])] == ["7", "3", "4"]


def test_zip64_and_comments(tmp_path):
    """A package whose central directory needs 64-bit fields, written by hand, with a comment that looks like an end."""
    data = b"hello stored"
    name = b"archive/data.warc.gz"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    pad = b"#" * 100
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), len(pad))
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = len(pad) + len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(central), 1)
    comment = b"PK\x05\x06" + b"?" * 30
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment
    path = tmp_path / "z.zip"
    path.write_bytes(pad + local + data + central + end64 + locator + end)
    reader = W.ZipReader(str(path))
    member = reader.members[name.decode()]
    assert (member.size, member.header) == (len(data), len(pad)) and reader.read(reader.start(member), member.size) == data


def test_damaged_packages(tmp_path):
    (tmp_path / "n.zip").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        W.ZipReader(str(tmp_path / "n.zip"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(W.ARCHIVE, b"x" * 1000)
    (tmp_path / "d.zip").write_bytes(out.getvalue())
    reader = W.ZipReader(str(tmp_path / "d.zip"))
    with pytest.raises(ValueError):
        reader.start(reader.members[W.ARCHIVE])


def test_packages_roll(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ROLL_RECORDS", 4)
    df = spark.createDataFrame([(i, "p%d" % i) for i in range(10)], "page_id long, html string").coalesce(1)
    manifest = W.write_archives(df, str(tmp_path / "r"), url_col=None)
    assert sum(r.n_records for r in manifest.collect()) == 10 and W.read_archives(manifest).count() == 10


def test_nothing_inside_an_article_is_lost():
    lost = "<p>{}</p>".format
    page = (
        "<html><body><nav>menu</nav><article class='post'>" + lost("one " * 30) + "<div class='side-by-side'>" + lost("two " * 20) + "</div><div class='meta-analysis'>"
        + lost("three " * 20) + "</div><p data-x='a hidden thing'>four</p><fieldset><p>five</p></fieldset><div class='comments'>" + lost("spam") + "</div>"
        "<p hidden>six</p><p style='color:red; display: none'>seven</p></article><div class='site-footer'>foot</div></body></html>"
    )
    text = H.extract_page(page, None)
    assert [w for w in ("one", "two", "three", "four", "five") if w not in text.split()] == []
    assert not {"menu", "spam", "six", "seven", "foot"} & set(text.split())


def test_foreign_records_and_members(tmp_path):
    import base64
    import gzip
    import hashlib
    import zipfile

    def made(kind, block, *more, mime="application/http; msgtype=response"):
        head = "".join(f"{k}: {v}\r\n" for k, v in (("WARC-Type", kind), ("Content-Type", mime), ("Content-Length", len(block)), *more))
        return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"

    body = b"<p>hello</p>"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        made("warcinfo", b"software: x\r\n", mime="application/warc-fields"),
        made("response", b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + body, ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Target-URI", "http://a.org/")),
        made("revisit", b"HTTP/1.1 200 OK\r\n\r\n", ("WARC-Refers-To", "<urn:uuid:1>"), ("WARC-Payload-Digest", f"sha1:{sha1}")),
    ]
    data, lines, at = b"", [], 0
    for i, r in enumerate(records):
        packed = gzip.compress(r)
        lines.append(f'org,a)/ 2020010100000{i} {{"url": "http://a.org/", "offset": "{at}", "length": "{len(packed)}", "filename": "crawl-1.warc.gz"}}')
        data, at = data + packed, at + len(packed)
    with zipfile.ZipFile(tmp_path / "p.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/crawl-0.warc.gz", b"")
        z.writestr("archive/crawl-1.warc.gz", data)
        z.writestr("indexes/main.cdxj", "\n".join(lines))
    reader = W.ZipReader(str(tmp_path / "p.wacz"))
    info, response, revisit = reader.records()
    assert (info.kind, info.payload, info.page) == ("warcinfo", b"software: x\r\n", None)
    assert (response.payload, response.payload_bytes, response.digest, response.url) == (body, len(body), sha1, "http://a.org/")
    assert (revisit.payload, revisit.payload_bytes, revisit.refers) == (None, None, "<urn:uuid:1>")
    reader.close()
    with pytest.raises(ValueError):
        W.parse_record(made("response", b"HTTP/1.1 200 OK\r\n\r\nx", ("WARC-Payload-Digest", f"sha1:{sha1}")))


def test_revisits_name_the_response_record():
    payload = b"x" * 200
    first, again = (W._head(W.record(k, p, "http://a/", payload, "d", r))[0] for k, p, r in (("response", "1", None), ("revisit", "2", "1")))
    assert again["warc-refers-to"] == first["warc-record-id"] != again["warc-record-id"] and again["x-refers-to-page-id"] == "1"
