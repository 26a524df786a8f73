"""Sources, sinks, fetches and the staged pipeline."""

import http.server
import threading

import pytest

from gleanwork import fixtures as X
from gleanwork.plans import pipeline
from gleanwork.plans.registry import all_rules
from gleanwork.schemas import BOARDS, POSTINGS_RAW
from gleanwork.sources import fetches, sinks, tables


def test_csv_scan_keeps_line_breaks_and_skips_comments(spark, tmp_path):
    path = tmp_path / "boards.csv"
    path.write_text('company,url\n"Ac""me\nInc",https://a\n# old,https://b\n,https://c\n')
    rows = tables.read_boards(spark, str(path)).collect()
    assert [(r.company, r.url) for r in rows] == [('Ac"me\nInc', "https://a"), (None, "https://c")]


def test_missing_file_is_an_empty_table(spark, tmp_path):
    assert tables.read_or_empty(spark, str(tmp_path / "none.csv"), BOARDS).count() == 0
    assert tables.file_stamp(spark, str(tmp_path / "none.csv")) == "never"


def test_word_list(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" Python \n\nÉCOLE\n")
    assert sorted(r.word for r in tables.read_words(spark, str(tmp_path / "w.txt")).collect()) == ["python", "école"]


def test_locale_files(spark, tmp_path):
    (tmp_path / "values_en.json").write_text('{"A": "x"}')
    assert [tuple(r) for r in tables.locale_table(spark, str(tmp_path)).collect()] == [("en", "A", "x")]


def test_sink_ignores_other_columns_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 1), ("c", "d", 2)], "company string, url string, x int")
    assert sinks.write_table(df, str(tmp_path / "t"), ["company", "url"])["rows"] == 2
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["company", "url"]


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/page")
                self.end_headers()
                return
            self.send_response(200 if self.path in ("/page", "/latin", "/image") else 404)
            self.send_header("Content-Type", {"/latin": "text/html; charset=iso-8859-1", "/image": "image/png"}.get(self.path, "text/html"))
            self.end_headers()
            self.wfile.write("é".encode("iso-8859-1" if self.path == "/latin" else "utf-8"))

        def log_message(self, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{s.server_address[1]}"
        s.shutdown()


def test_http_source(spark, server):
    fetches.register(spark)
    urls = [f"{server}/{x}" for x in ("page", "latin", "image", "moved", "gone")] + ["http://127.0.0.1:9/x"]
    rows = {r.url.rsplit("/", 1)[-1]: r for r in spark.read.format("http_pages").option("urls", "\n".join(urls)).option("delay", 0).load().collect()}
    assert (rows["page"].body, rows["latin"].body, rows["image"].body) == ("é", "é", None)
    assert rows["moved"].final_url.endswith("/page") and len(rows["moved"].redirect_chain) == 2
    assert rows["gone"].status == 404 and rows["x"].error


def test_usable_fetches(spark):
    rows = [("a", 200, "text/html", "x", None), ("b", 200, None, "x", None), ("c", 404, "text/html", "x", None), ("d", 200, "image/png", "x", None), ("e", 200, "text/html", "", None), ("f", None, None, None, "Timeout")]
    df = spark.createDataFrame(rows, "url string, status int, content_type string, body string, error string")
    assert sorted(r.url for r in fetches.usable(df).collect()) == ["a", "b"]


def test_rules_are_complete_and_unique():
    rules = all_rules()
    assert len(rules) == 379
    assert len({r.signal_id for r in rules}) == 379


def test_stage_slice():
    assert pipeline.stage_slice("filter", "refilter") == ("filter", "detail", "refilter")
    for a, b in (("store", "scrape"), ("x", "store")):
        with pytest.raises(ValueError):
            pipeline.stage_slice(a, b)


def test_pipeline_resumes(spark, tmp_path):
    boards = spark.createDataFrame([("https://a.fr/careers", "Acme", None, None, None)], "board_url string, company string, ats string, final_url string, html string")
    body = "<body><main>Python and Java and Docker and Kubernetes and SQL</main></body>"
    pages = [("https://a.fr/sitemap.xml", X.SITEMAP.replace("orchard.fr", "a.fr").replace("1-dev", "1-python-java"))] + [(f"https://a.fr/jobs/{x}", body) for x in ("1-python-java", "2-ops", "333")]
    data = spark.createDataFrame([(u, "GET", None, 200, "text/html", u, b) for u, b in pages], "url string, method string, request_body string, status int, content_type string, final_url string, body string")
    s = pipeline.Settings(str(tmp_path), ["python", "java", "docker", "kubernetes", "sql"], [], boards, data)
    found = pipeline.run(spark, s)
    assert found["scrape"]["rows"] == 3 and found["filter"]["rows"] == 2 and found["store"]["rows"] == 2
    again = pipeline.run(spark, s, "detail")
    assert again["detail"]["rows"] == 0 and again["store"]["rows"] == 0
    assert spark.read.schema(POSTINGS_RAW).parquet(str(tmp_path / "jobs")).count() == 3
