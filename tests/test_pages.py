"""The page source against a server of our own."""

import gzip
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessella.sources import pages

LONG = "word " * 40


class Handler(BaseHTTPRequestHandler):
    running, most, asked, lock = 0, 0, [], threading.Lock()

    def do_GET(self):
        cls = type(self)
        with cls.lock:
            cls.running += self.path != "/hang"  # its client gives up long before it ends
            cls.most = max(cls.most, cls.running)
            cls.asked.append(self.path)
        try:
            time.sleep(5 if self.path == "/hang" else 0.15)
            body, status = f"<html><script>no</script><p>{self.path} {LONG} café</p></html>".encode(), 200
            if self.path == "/missing":
                status = 404
            if self.path == "/short":
                body = b"<p>tiny</p>"
            if self.path == "/zip":
                body = gzip.compress(body)
            self.send_response(status)
            if self.path == "/zip":
                self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body)
        except OSError:
            pass  # the client gave up
        finally:
            with cls.lock:
                cls.running -= self.path != "/hang"

    def log_message(self, *args):
        pass


@pytest.fixture()
def server():
    Handler.running, Handler.most, Handler.asked = 0, 0, []
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_source_gives_a_status_for_each_address_in_order(spark, server):
    urls = [f"{server}/a", f"{server}/missing", f"{server}/manual.PDF", f"{server}/short", f"{server}/hang", f"{server}/zip", "http://127.0.0.1:9/refused", None, "ftp://x/y", "nonsense", f"{server}/a"]
    got = pages.read_pages(spark, urls, pages.Limits(timeout=1.0, workers=3), tasks=4).orderBy("place").collect()
    assert [r.url for r in got] == urls and [r.place for r in got] == list(range(len(urls)))
    assert [r.status for r in got] == ["fetched", "failed", "pdf_skipped", "failed", "failed", "fetched", "failed", "failed", "failed", "failed", "fetched"]
    assert got[0].text == f"/a {LONG} café" and got[0].chars == len(got[0].text) and got[5].text.endswith("café") and got[0].error is None
    assert "404" in got[1].error and got[3].error == "no usable text (4 chars)" and got[3].chars == 4 and "timed out" in got[4].error and got[7].error == "no web address"
    assert "/manual.PDF" not in Handler.asked and 1 < Handler.most <= 3  # one host: one task's threads


def test_hosts_are_dealt_whole_and_evenly():
    urls = [f"http://h{i % 7}.example/{i}" for i in range(70)] + [f"http://big.example/{i}" for i in range(40)]
    import json

    parts = pages.PageReader({"addresses": json.dumps(urls), "tasks": "3"}).partitions()
    hosts = [{pages._host(u) for _, u in p.asked} for p in parts]
    assert len(parts) == 3 and sum(map(len, hosts)) == len(set.union(*hosts)) == 8
    assert sorted(place for p in parts for place, _ in p.asked) == list(range(110)) and max(len(p.asked) for p in parts) <= 50
    assert len(pages.PageReader({"addresses": "[]"}).partitions()) == 1


def test_table_of_sources_asks_each_address_once(spark, server):
    rows = [(1, f"{server}/a"), (2, f"{server}/b"), (3, f"{server}/a"), (4, None), (5, f"{server}/missing"), (6, f"{server}/x.pdf")]
    df = spark.createDataFrame(rows, "id int, url string")
    got = {r.id: (r.status, r.text and r.text[:2], r.chars and r.chars > 50) for r in pages.fetched_pages(df, tasks=3).collect()}
    assert got == {1: ("fetched", "/a", True), 2: ("fetched", "/b", True), 3: ("fetched", "/a", True), 4: ("failed", None, None), 5: ("failed", None, None), 6: ("pdf_skipped", None, None)}
    assert sorted(Handler.asked) == ["/a", "/b", "/missing"]
    assert pages.fetched_pages(df.where("false")).count() == 0
