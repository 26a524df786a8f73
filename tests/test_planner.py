"""Rounds of planned requests against a local server."""

import http.server
import json
import threading

import pytest

from gleanwork.plans.registry import Feed
from gleanwork.sources import connectors, fetches, planner

BOARDS = "board_url string, company string, ats string, final_url string, html string"


@pytest.fixture
def site():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, body, status=200):
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body.encode())

        def do_POST(self):
            sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, sent["offset"]))
            jobs = [{"title": f"Sailor {i}", "externalPath": f"/job/{i}", "locationsText": "Oslo"} for i in range(sent["offset"], min(47, sent["offset"] + sent["limit"]))]
            self.answer(json.dumps({"total": 47, "jobPostings": jobs}))

        def do_GET(self):
            asked.append((self.path, None))
            here = f"http://{self.headers['Host']}"
            if self.path.startswith("/feed"):
                at = int(self.path.partition("offset=")[2] or 0)
                self.answer(json.dumps({"count": 230, "rows": [{"id": i, "name": f"Cook {i}"} for i in range(at, min(230, at + 100))]}))
            elif self.path == "/wp-json/wp/v2/types":
                self.answer(json.dumps({"page": {}, "jobs": {}}))
            elif self.path.startswith("/wp-json/wp/v2/jobs"):
                page = int(self.path.rpartition("=")[2])
                self.answer(json.dumps([{"title": {"rendered": f"Mate {page}-{i}"}, "link": f"{here}/x/{page}/{i}"} for i in range({1: 100, 2: 100, 3: 5}.get(page, 0))]))
            elif self.path == "/sitemap_index.xml":
                self.answer(f"<loc>{here}/job-list.xml</loc>")
            elif self.path == "/job-list.xml":
                self.answer("".join(f"<loc>{here}/jobs/{i}-pilot-wanted</loc>" for i in range(4)))
            else:
                self.answer("", 404)

        def log_message(self, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{s.server_address[1]}", asked
        s.shutdown()


def quick(requests):
    return fetches.fetch_requests(requests, delay=0)


def test_feeds_are_paged_to_their_total(spark, site, tmp_path, monkeypatch):
    root, asked = site
    feed = Feed("boxed", f"{root}/feed/{{token}}?n=100", (r"/boards/([a-z]+)",), "rows", "name", "place", link_url="https://boxed.example/{token}/{id}", total="count", param="offset")
    monkeypatch.setattr(connectors, "FEEDS", (feed,))
    boards = spark.createDataFrame([(f"{root}/boards/harbour", "Harbour", "boxed", None, None)], BOARDS)
    known = planner.gather(boards, str(tmp_path / "f"), quick)
    assert sorted(p for p, _ in asked) == ["/feed/harbour?n=100", "/feed/harbour?n=100&offset=100", "/feed/harbour?n=100&offset=200"]
    assert connectors.feed_postings(boards, known).count() == 230
    planner.gather(boards, str(tmp_path / "f"), quick)
    assert len(asked) == 3  # nothing is asked twice


def test_wordpress_pages_follow_until_a_short_one(spark, site, tmp_path, monkeypatch):
    root, asked = site
    monkeypatch.setattr(connectors, "FEEDS", connectors.FEEDS[:1])
    boards = spark.createDataFrame([(f"{root}/work-with-us", "Harbour", None, None, "<img src='/wp-content/a.png'>")], BOARDS)
    known = planner.gather(boards, str(tmp_path / "f"), quick)
    assert connectors.wordpress_postings(boards, known).count() == 205
    assert [p for p, _ in asked] == ["/wp-json/wp/v2/types", *(f"/wp-json/wp/v2/jobs?per_page=100&page={i}" for i in (1, 2, 3))]


def test_sitemaps_are_searched_place_by_place(spark, site, tmp_path, monkeypatch):
    root, asked = site
    monkeypatch.setattr(connectors, "FEEDS", connectors.FEEDS[:1])
    boards = spark.createDataFrame([(f"{root}/work-with-us", "Harbour", None, None, "<p>plain</p>")], BOARDS)
    known = planner.gather(boards, str(tmp_path / "f"), quick)
    found = connectors.sitemap_postings(boards, known).collect()
    assert len(found) == 4 and {r.via for r in found} == {"sitemap"}
    assert [p for p, _ in asked][:3] == ["/sitemap.xml", "/sitemap_index.xml", "/job-list.xml"]
    assert sorted(p for p, _ in asked[3:]) == [f"/jobs/{i}-pilot-wanted" for i in range(4)]


def test_workday_pages_are_posted(spark, site, tmp_path, monkeypatch):
    root, asked = site
    tenant = "https://harbour.wd5.myworkdayjobs.com"
    boards = spark.createDataFrame([(f"{tenant}/open", "Harbour", "workday", None, None)], BOARDS)

    def local(requests):
        from pyspark.sql import functions as F

        made = quick(requests.withColumn("url", F.replace("url", F.lit(tenant), F.lit(root))))
        return made.withColumn("url", F.replace("url", F.lit(root), F.lit(tenant)))

    monkeypatch.setattr(connectors, "FEEDS", connectors.FEEDS[:1])
    known = planner.gather(boards, str(tmp_path / "f"), local)
    assert [o for _, o in asked] == [0, 20, 40]
    assert connectors.workday_postings(boards, known).count() == 47


def test_source_sends_posts(spark, site):
    root, asked = site
    fetches.register(spark)
    line = json.dumps({"url": f"{root}/wday", "method": "post", "request_body": json.dumps({"limit": 20, "offset": 40})})
    row = spark.read.format("http_pages").option("requests", line).option("delay", 0).load().first()
    assert (row.method, row.status, len(json.loads(row.body)["jobPostings"])) == ("POST", 200, 7) and asked == [("/wday", 40)]
