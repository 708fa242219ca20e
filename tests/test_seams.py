import http.server
import sys
import threading

import pytest
from pyspark.sql import functions as F

from quillspark.sources import fetch, tools


@pytest.fixture(scope="module")
def site():
    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            code = {"/broken": 503, "/missing": 404}.get(self.path, 200)
            body = b"x" * 5000 if self.path == "/big" else b"hello"
            self.send_response(code)
            if self.path != "/big":
                self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, site):
    rows = spark.createDataFrame([(site + p, None) for p in ("/ok", "/big", "/broken", "/missing")] + [("http://127.0.0.1:9/", "rib"), (None, None)], "url string, hint string")
    got = {r["url"] and r["url"].removeprefix(site): r for r in fetch.fetched(rows, most=1000).collect()}
    assert bytes(got["/ok"]["content"]) == b"hello" and got["/ok"]["status"] == 200
    assert (got["/big"]["status"], got["/big"]["error"]) == (422, "File too big")
    assert (got["/broken"]["status"], got["/broken"]["upstream_status"], got["/broken"]["upstream_body"]) == (502, 503, "hello")
    assert (got["/missing"]["status"], got["/missing"]["upstream_status"]) == (500, 404)
    assert got["http://127.0.0.1:9/"]["status"] == 500 and got[None]["status"] == 422


def test_tools(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "id long, content binary")
    copy = (sys.executable, "-c", "import sys; sys.stdout.buffer.write(sys.stdin.buffer.read()[::-1])")
    assert {r["id"]: r["o"]["output"] and bytes(r["o"]["output"]) for r in rows.select("id", tools.tool_output(F.col("content"), copy).alias("o")).collect()} == {1: b"cba", 2: None}
    assert tools.run_tool(b"", ("no-such-program",)) == (None, "no-such-program is not installed")
    assert tools.run_tool(b"", (sys.executable, "-c", "exit(3)"))[1].endswith("failed with 3")


def test_routes(spark):
    cases = [(" \n", False, 3, "image"), ("x", True, 0, "text"), ("x", False, 1, "image"), ("x", False, 2, "none"), (None, False, 0, "image")]
    rows = spark.createDataFrame(cases, "t string, r boolean, n int, want string")
    assert rows.where(tools.pdf_route(F.col("t"), F.col("r"), F.col("n")) != F.col("want")).count() == 0
    listing = spark.createDataFrame([(bytearray(b"page num\n----\n1 0\n2 1\n"),), (bytearray(b""),)], "o binary")
    assert sorted(r["n"] for r in listing.select(tools.listed_images(F.col("o")).alias("n")).collect()) == [0, 2]
