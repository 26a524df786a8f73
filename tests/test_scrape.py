"""What a scrape leaves to the steps after it, and feeds of several platforms read by one join."""

from pyspark.sql import functions as F

from gleanwork.operators import details
from gleanwork.sources import connectors

BOARDS = "board_url string, company string, ats string, final_url string, html string"
FETCHES = "url string, method string, request_body string, status int, body string"


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_scrape_holds_no_connector_and_no_broadcast(spark):
    page = '<a href="/jobs/41-ship-cook">Ship Cook</a>'
    xml = "<jobs><job><id>1</id><title> Cook </title><url>https://x/1</url></job><job><title/><url>https://x/2</url></job></jobs>"
    boards = [("https://a.fr/careers", "A", None, None, page), ("https://b.applytojob.com/", "B", "jazzhr", None, page), ("https://c.jobs.personio.de/", "C", "personio", None, page), ("https://jobs.lever.co/d", "D", "lever", None, None)]
    bodies = [("https://app.jazz.co/feeds/export/jobs/b", xml), ("https://c.jobs.personio.de/xml", xml[:40]), ("https://api.lever.co/v0/postings/d?mode=json", '[{"text": "Dev", "hostedUrl": "https://y/1"}, 3]')]
    boards = spark.createDataFrame(boards, BOARDS)
    fetches = spark.createDataFrame([(u, "GET", None, 200, b) for u, b in bodies], FETCHES)
    found = connectors.scrape(boards, fetches)
    assert sorted((r.company, r.title, r.url, r.via) for r in found.collect()) == [
        ("A", "Ship Cook", "https://a.fr/jobs/41-ship-cook", "links"), ("B", "Cook", "https://x/1", "feed"), ("D", "Dev", "https://y/1", "feed"),
    ]  # fmt: skip  (the feed of C is no XML, and its links have not its platform's shape)
    for rows in (found, details.read_details(found.withColumn("ats", F.lit("x")), fetches)):
        assert "Broadcast" not in plan_of(rows)
    assert "ArrowEvalPython" not in plan_of(found)
