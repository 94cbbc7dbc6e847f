"""Sources on a local server, and names of collected files."""

import http.server
import threading

import pytest

from glyphloom.functions import naming
from glyphloom.operators import provenance
from glyphloom.sources import archive


@pytest.fixture(scope="module")
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path = self.path.partition("?")[0]
            code = {"/slow": 429, "/gone": 404, "/index": 503 if "bad.vn" in self.path else 200}.get(path, 200)
            body = b"2003 http://x.vn/a b.doc\nbroken\n2004 http://x.vn/c.doc\n" if path == "/index" else b"x" * (10 if path == "/tiny" else 5000)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch(spark, server):
    urls = [f"{server}/ok", f"{server}/slow", f"{server}/gone", f"{server}/tiny", "http://127.0.0.1:1/", "no address", None]
    got = archive.fetched(spark.createDataFrame([(u,) for u in urls], "url string"), 2, 0.01).collect()
    assert {r.url: r.status for r in got} == dict(zip(urls, ["ok", "throttled", *["unfetched"] * 5], strict=True))
    assert [len(r.content) for r in got if r.content] == [5000]


def test_index(spark, server):
    spark.dataSource.register(archive.ArchiveIndex)
    df = spark.read.format("archive_index").options(endpoint=f"{server}/index", domains="x.vn, bad.vn", kind="doc", limit=5, pause=0.01).load()
    assert sorted(map(tuple, df.collect())) == [("x.vn", "2003", "http://x.vn/a b.doc"), ("x.vn", "2004", "http://x.vn/c.doc")]


@pytest.mark.parametrize(
    ("url", "stem"),
    [("http://x.vn/a/B%E1%BB%99%20T%C3%A0i.DOC", "Bo-Tai"), ("http://x.vn/d.php?file=q.rtf&name=z", "q"), ("http://x.vn/", "doc"), ("http://x.vn/" + "a" * 60 + ".pdf", "a" * 48), ("http://[x", "doc"), ("http://x.vn/--đ--.xls", "doc")],
)
def test_stem(url, stem):
    assert naming.stem_of(url, "doc") == stem


def test_names(spark):
    rows = [("http://x.vn/a.doc", "20030101", "doc"), ("http://x.vn/a.xls", "20030202", "xls"), ("http://x.vn/b.xls", "2004", "xls"), ("http://x.vn/b.doc", "2004", "doc"), ("http://x.vn/c.rtf", "2005", "rtf"), ("http://x.vn/c.rtf", "2005", "rtf")]
    held = spark.createDataFrame([("2004-b.doc",), ("notes.md",)], "file string")
    got = provenance.named(spark.createDataFrame(rows, "url string, timestamp string, kind string"), held)
    assert sorted(r.name for r in got.collect()) == ["2003-a-xls.xls", "2003-a.doc", "2004-b-xls.xls", "2004-b.doc", "2005-c.rtf", "2005-c.rtf"]
    assert provenance.named(got.limit(0).drop("name"), held.limit(0)).count() == 0


def test_replaced(spark):
    old, new = (spark.createDataFrame([(x,) for x in rows], "file string") for rows in (["a", "made-1", "made-2"], ["made-3"]))
    assert sorted(r.file for r in provenance.replaced(old, new, "made-").collect()) == ["a", "made-3"]
