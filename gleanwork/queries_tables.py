"""Registered queries of tables with versions, stored signals, keyed streams and XML, each with its SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanwork.cases import OWNED_SQL, owned
from gleanwork.functions import json_schema, registered
from gleanwork.functions import urls as U
from gleanwork.operators import detect as D
from gleanwork.operators import graph, sketches
from gleanwork.operators.ranges import numbered
from gleanwork.oracles import HOST
from gleanwork.plans import pipeline
from gleanwork.queries import Query, postings, stream_folder, table
from gleanwork.queries_planted import ORACLES as PLANTED
from gleanwork.queries_planted import planted_pages
from gleanwork.sources import catalog
from gleanwork.sources import connectors as C
from gleanwork.sources import fetches as FT
from gleanwork.sources.shared import materialise
from gleanwork.sources.signal_store import SignalStore
from gleanwork.sources.versioned import Conflict, VersionedTable
from gleanwork.streaming import keyed

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- versions --------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, md5(text) AS url, CASE WHEN min(CASE WHEN doc_id % 5 = 0 THEN doc_id END) IS NULL THEN 2 ELSE 1 END AS version FROM documents GROUP BY text")
def inserted_once(spark, sf_dir):
    """Two inserts of which the second holds the first's rows too: each URL once, with the version that brought it."""
    p = postings(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("description").alias("url"))
    # the least id of each text is in the batch that comes first
    least = p.groupBy("url").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id") % 5 == 0).alias("early"))
    rows = p.join(least, "url").withColumn("doc_id", F.col("least"))
    kept = VersionedTable(spark, f"{stream_folder(spark)}/postings", "doc_id long, url string")
    for batch in (rows.where("early"), rows):
        kept.insert_new(batch, "url", "doc_id")
    first, second = kept.read(1).withColumn("version", F.lit(1).cast("long")), kept.read(2)
    return first.unionByName(second.join(kept.read(1).select("url"), "url", "left_anti").withColumn("version", F.lit(2).cast("long")))


@query("""SELECT 'first' AS step, CAST(count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN text END) AS BIGINT) AS n FROM documents
    UNION ALL SELECT 'broken', CAST(count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN text END) AS BIGINT) FROM documents
    UNION ALL SELECT 'both', CAST(count(DISTINCT text) AS BIGINT) FROM documents
    UNION ALL SELECT 'loose parts', 0""")
def insert_transactions(spark, sf_dir):
    """Rows after an insert, after one that breaks off in a task, and after two writers that start from one version."""
    p = postings(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("description").alias("url"))
    kept = VersionedTable(spark, f"{stream_folder(spark)}/postings", "doc_id long, url string")
    even = p.where("doc_id % 2 = 0")
    kept.insert_new(even, "url", "doc_id")
    counts = [("first", kept.read().count())]
    worst = p.withColumn("url", F.when(F.col("doc_id") == p.agg(F.max("doc_id")).first()[0], F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("url")))
    try:
        kept.insert_new(worst, "url", "doc_id")
        raise AssertionError("the insert should have failed")
    except Exception as e:  # noqa: BLE001
        if "broken row" not in str(e):
            raise
    counts.append(("broken", kept.read().count()))
    rival = [p.where("doc_id % 3 = 0")]

    def other_writer() -> None:
        while rival:
            VersionedTable(spark, kept.path, kept.schema).insert_new(rival.pop(), "url", "doc_id")

    kept.insert_new(p, "url", "doc_id", before_publish=other_writer)
    found = kept.read()
    if found.count() != found.select("url").distinct().count():
        raise Conflict("a URL is there twice")
    counts += [("both", found.count()), ("loose parts", kept.vacuum())]
    return spark.createDataFrame(counts, "step string, n long")


# --- stored signals -----------------------------------------------------------------


@query("""SELECT 'first' AS run, CAST(count(*) FILTER (page_id % 10 > 0) AS BIGINT) AS pages, CAST(count(DISTINCT CASE WHEN page_id % 10 > 0 THEN url || chr(10) || html END) AS BIGINT) AS parsed FROM pages
    UNION ALL SELECT 'second', CAST(count(*) AS BIGINT), CAST(count(DISTINCT url || chr(10) || html) - count(DISTINCT CASE WHEN page_id % 10 > 0 THEN url || chr(10) || html END) AS BIGINT) FROM pages
    UNION ALL SELECT 'third', CAST(count(*) AS BIGINT), 0 FROM pages""")
def parsed_once(spark, sf_dir):
    """Contents parsed by a first run over nine tenths of the pages, by one over all, and by one over all again."""
    store, pages = SignalStore(spark, f"{stream_folder(spark)}/signals"), table(spark, sf_dir, "pages")
    runs = [("first", pages.where("page_id % 10 > 0")), ("second", pages), ("third", pages)]
    return spark.createDataFrame([(name, *store.refresh(rows).values()) for name, rows in runs], "run string, pages long, parsed long")


@query(PLANTED["planted_verdicts"])
def stored_verdicts(spark, sf_dir):
    """Verdicts from stored signals, which were brought in by two runs."""
    store, pages = SignalStore(spark, f"{stream_folder(spark)}/signals"), planted_pages(spark, sf_dir)
    for rows in (pages.where("page_id % 3 = 0"), pages):
        store.refresh(rows)
    found = D.detect_signals(store.signals(pages))
    return found.select("page_id", "detected_ats", "status", "score", "confidence", F.array_join("conflicts", ",").alias("conflicts"), "unknown_vendor")


# --- streams --------------------------------------------------------------------------


@query("""WITH e AS (SELECT *, ntile(3) OVER (ORDER BY ts, event_id) AS part FROM events), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part, ts, event_id) AS k FROM e) WHERE k = 1)
    SELECT user_id, event_id, CAST(part - 1 AS BIGINT) AS epoch, row_number() OVER (PARTITION BY part ORDER BY ts, event_id) AS id FROM f""")
def keyed_stream(spark, sf_dir):
    """Events in three parts by time, the stream started anew for each: a user's first event counts, by keyed state."""
    folder = stream_folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    events = materialise(numbered(events, ["at", "event_id"], "n"), "numbered-events")
    size, rest = divmod(events.count(), 3)  # as ntile deals them: the first parts take what is left over
    rows = events.drop("n")
    target = VersionedTable(spark, f"{folder}/firsts", keyed.stored_schema(rows.schema))
    for k in range(3):
        start = k * size + min(k, rest)
        part = (events["n"] > start) & (events["n"] <= start + size + (k < rest))
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        keyed.insert_stream(spark, stream, target, f"{folder}/state", "user_id", "at", "event_id")
    found = target.read()
    epochs = found.select("epoch").distinct()  # one for each batch of the stream
    nth = epochs.select("epoch", (F.dense_rank().over(Window.orderBy("epoch")) - 1).cast("long").alias("nth"))
    return found.join(F.broadcast(nth), "epoch").select("user_id", "event_id", F.col("nth").alias("epoch"), "id")


@query("SELECT url, md5(html) AS digest, 200 AS status, CAST(1 AS BIGINT) AS asked FROM pages")
def fetched_stream(spark, sf_dir):
    """Requests as a stream that is stopped and started again, some of them twice in it: each is asked once, by hosts, and its answer stored."""
    folder, pages = stream_folder(spark), table(spark, sf_dir, "pages").select("page_id", "url", "html")
    schema = "page_id long, url string"
    asked = VersionedTable(spark, f"{folder}/asked", "url string")
    target = VersionedTable(spark, f"{folder}/answers", "url string, status int, body string, epoch long")

    def backend(requests):  # noqa: ANN001, ANN202
        asked.append(requests.select("url"))
        by_host = requests.repartition(U.host_of("url")).sortWithinPartitions("url")
        return by_host.join(pages.select("url", F.col("html").alias("body")), "url").withColumn("status", F.lit(200))

    for run in (pages.where("page_id % 3 = 0"), pages.where("page_id % 2 = 0"), pages):
        run.select("page_id", "url").coalesce(1).write.mode("append").parquet(f"{folder}/requests")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/requests")
        keyed.insert_stream(spark, stream, target, f"{folder}/state", "url", "page_id", work=backend)
    times = asked.read().groupBy("url").agg(F.count("*").alias("asked"))
    return target.read().join(times, "url").select("url", F.md5("body").alias("digest"), "status", "asked")


# --- reports that add up ------------------------------------------------------------------


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY 1")
def weekly_distinct(spark, sf_dir):
    """Distinct users of each week from the stored sketches of its days, held against the exact count."""
    events = table(spark, sf_dir, "events")
    at = f"{stream_folder(spark)}/sketches"
    sketches.daily_sketches(events, "ts", "user_id").write.parquet(at)
    week = lambda c: F.trunc(c, "week").alias("week")
    found = sketches.distinct_in(spark.read.parquet(at), "user_id", week("day"))
    exact = events.groupBy(week(F.to_date("ts"))).agg(F.countDistinct("user_id").alias("exact"))
    return exact.join(found, "week").select("week", "exact", (F.abs(F.col("n_user_id") - F.col("exact")) <= 0.03 * F.col("exact") + 1).alias("close"))


# --- links --------------------------------------------------------------------------------


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), links AS (SELECT DISTINCT page_id AS source, unnest([(page_id * 7 + 1) % (SELECT n FROM n), (page_id * 11 + 3) % (SELECT n FROM n), page_id]) AS target FROM pages),
    r(start, node, depth) AS (SELECT page_id, page_id, 0 FROM pages WHERE page_id % 20 = 0 UNION SELECT start, target, depth + 1 FROM r JOIN links ON node = source WHERE depth < 6)
    SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY start, node""")
def linked_pages(spark, sf_dir):
    """What every twentieth page reaches in six steps over links with cycles."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    n = pages.count()
    k = F.col("page_id")
    links = pages.select(k.alias("source"), F.explode(F.array((k * 7 + 1) % n, (k * 11 + 3) % n, k)).alias("target"))
    found = graph.reachable(links, pages.where(k % 20 == 0).select(k.alias("node")), 6)
    return found.select("start", "node", F.col("depth").cast("long").alias("depth"))


# --- XML ----------------------------------------------------------------------------------


def xml_feeds(spark, sf_dir):  # noqa: ANN001, ANN201
    """A feed for each page: items with markup in CDATA, a nested element of the item's own name, comments, attributes with signs; every seventh is cut off."""
    rows = owned(spark, sf_dir)
    own, k = F.col("own"), F.col("page_id")
    item = lambda i, body: F.concat(F.lit(f'<job note="a > b" id="{i}"><!-- <title>no</title> -->'), body, F.lit("</job>"))
    first = item(1, F.concat(F.lit("<title lang='x'><![CDATA[Cook <1> & "), own, F.lit("]]></title><city> Oslo &amp; Turku </city><place><city>Inner</city></place><url>https://"), own, F.lit("/1</url>")))
    second = item(2, F.concat(F.lit("<related><job><title>Nested</title></job></related><title>"), own, F.lit("</title><url/>")))
    last = F.when(k % 7 == 0, F.lit("<job><title>cut")).otherwise(F.lit("</feed>"))
    return rows.select("page_id", F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://x/">'), first, second, last).alias("body"))


@query(f"""WITH o AS ({OWNED_SQL}) SELECT page_id, 0::BIGINT AS pos, 'Cook <1> & ' || own AS title, 'Oslo & Turku' AS city, 'Inner' AS inner_city, 'https://' || own || '/1' AS url FROM o WHERE page_id % 7 > 0
    UNION ALL SELECT page_id, 1, own, NULL, NULL, NULL FROM o WHERE page_id % 7 > 0""")
def xml_feed_items(spark, sf_dir):
    found = C.xml_records(xml_feeds(spark, sf_dir), "job", ["title", "city", "place.city", "url"])
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("item_title").alias("title"), F.col("item_city").alias("city"), F.col("`item_place.city`").alias("inner_city"), F.col("item_url").alias("url"))


@query("SELECT page_id FROM pages WHERE page_id % 7 = 0")
def broken_xml(spark, sf_dir):
    """Feeds that are no XML, with their bodies kept."""
    rows = xml_feeds(spark, sf_dir).withColumn("x", C.xml_parsed("body", "job", ["title"]))
    return rows.where("x._broken = body").select("page_id")


@query("SELECT event_id, user_id, event_type, props FROM events")
def xml_file_rows(spark, sf_dir):
    """Rows written as XML files and read back by their row tag."""
    at = f"{stream_folder(spark)}/events"
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    rows.write.format("xml").option("rowTag", "event").option("rootTag", "events").save(at)
    return spark.read.format("xml").option("rowTag", "event").schema(rows.schema).load(at)


# --- bodies and tables ----------------------------------------------------------------------

VERDICT_SCHEMA = {
    "type": "object", "required": ["adequation_grade", "depth_analysis"],
    "properties": {
        "adequation_grade": {"type": "integer", "minimum": 0, "maximum": 100}, "depth_analysis": {"type": "string", "minLength": 1},
        "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "enum": ["a", "b"]}}, "locale": {"type": "string", "pattern": "^[a-z]{2}$"},
    },
}


@query("""WITH g AS (SELECT doc_id AS k, quality * 60 + doc_id % 50 AS grade FROM labels)
    SELECT k AS doc_id, CASE WHEN k % 13 = 0 THEN '$: no JSON' ELSE concat_ws('; ',
      CASE WHEN k % 11 = 0 THEN '$.adequation_grade: not an integer' WHEN grade > 100 THEN '$.adequation_grade: above 100' END,
      CASE WHEN k % 7 = 0 THEN '$.depth_analysis: missing' WHEN k % 6 = 0 THEN '$.depth_analysis: shorter than 1' END,
      CASE WHEN k % 5 = 3 THEN '$.tags: more than 2 items' END, CASE WHEN k % 5 IN (2, 3) THEN '$.tags[]: not one of a, b' END, CASE WHEN k % 4 = 1 THEN '$.locale: does not match ^[a-z]{2}$' END) END AS reasons,
      CASE WHEN k % 13 > 0 AND k % 11 > 0 AND grade <= 100 AND k % 7 > 0 AND k % 6 > 0 AND k % 5 NOT IN (2, 3) AND k % 4 <> 1 THEN CAST(grade AS BIGINT) END AS grade FROM g""")
def schema_reasons(spark, sf_dir):
    """Why bodies made from labels do not follow a schema, and the grades of those that do."""
    k = F.col("doc_id")
    grade = (F.col("quality") * 60 + k % 50).cast("string")
    parts = F.array(
        F.concat(F.lit('"adequation_grade": '), F.when(k % 11 == 0, F.concat(F.lit('"'), grade, F.lit('"'))).otherwise(grade)),
        F.when(k % 7 > 0, F.when(k % 6 == 0, F.lit('"depth_analysis": ""')).otherwise(F.lit('"depth_analysis": "fits"'))),
        F.when(k % 5 == 1, F.lit('"tags": ["a", "b"]')).when(k % 5 == 2, F.lit('"tags": ["c", "d"]')).when(k % 5 == 3, F.lit('"tags": ["a", "c", "b"]')),
        F.when(k % 4 == 1, F.lit('"locale": "eng"')).when(k % 4 == 2, F.lit('"locale": "en"')).when(k % 4 == 3, F.lit('"locale": null')),
    )
    body = F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda x: x.isNotNull()), ", "), F.when(k % 13 == 0, F.lit("")).otherwise(F.lit("}")))
    rows = table(spark, sf_dir, "labels").select("doc_id", body.alias("body"))
    return rows.select("doc_id", F.array_join(json_schema.reject_reasons("body", VERDICT_SCHEMA), "; ").alias("reasons"), json_schema.parsed("body", VERDICT_SCHEMA)["adequation_grade"].alias("grade"))


@query("SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'none' ELSE 'feed' END AS via, CAST(CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS BIGINT) AS rank FROM events")
def migrated_table(spark, sf_dir):
    """A table by name: created once, filled, given two columns with defaults (twice), filled again."""
    name, events = f"stored_{uuid.uuid4().hex}", table(spark, sf_dir, "events")
    made = [catalog.ensure_table(spark, name, "event_id BIGINT, event_type STRING", f"{stream_folder(spark)}/table") for _ in range(2)]
    catalog.insert_by_name(events.where("event_id % 2 = 0").select("event_id", "event_type"), name)
    added = [catalog.add_columns(spark, name, {"via": ("STRING", "'none'"), "rank": ("BIGINT", "0")}) for _ in range(2)]
    if made != [True, False] or added != [["via", "rank"], []]:
        raise AssertionError((made, added))
    catalog.insert_by_name(events.where("event_id % 2 = 1").select(F.col("user_id").alias("rank"), "event_type", F.lit("feed").alias("via"), "event_id"), name)
    return spark.table(name).select("event_id", "event_type", "via", "rank")


# --- fetched bytes, and all stages ------------------------------------------------------------


@query("""SELECT page_id, md5(CASE page_id % 5 WHEN 3 THEN html || chr(65533) WHEN 4 THEN url || 'é' ELSE html END) AS digest FROM pages""")
def decoded_bodies(spark, sf_dir):
    """Bodies as bytes in the charset that their type declares, quoted or not, in none, in an unknown one, with a bad byte, and in Latin-1."""
    k = F.col("page_id") % 5
    utf8 = F.encode("html", "UTF-8")
    raw = F.when(k == 1, F.encode("html", "UTF-16LE")).when(k == 3, F.concat(utf8, F.unhex(F.lit("FF")))).when(k == 4, F.encode(F.concat("url", F.lit("é")), "ISO-8859-1")).otherwise(utf8)
    kind = F.when(k == 1, 'text/html; x=1; Charset="UTF-16LE"').when(k == 2, "text/html; charset=x-none").when(k == 4, "text/html;charset=iso-8859-1").when(k == 0, F.lit(None)).otherwise("text/html")
    rows = table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), kind.alias("kind"))
    return rows.select("page_id", F.md5(FT.text_of_bytes("raw", "kind")).alias("digest"))


@query(f"""WITH o AS ({OWNED_SQL}), j AS (SELECT page_id, own, unnest([41, 42]) AS n FROM o)
    SELECT 'https://' || own || '.fr/jobs/' || n || CASE n WHEN 41 THEN '-ship-cook' ELSE '-deck-hand' END AS url, own AS company, CASE n WHEN 41 THEN 'Ship Cook' ELSE 'Deck Hand' END AS title,
      'Work' || repeat(' cook deck', CAST(page_id % 4 AS INTEGER)) AS description FROM j WHERE 4 + 2 * (page_id % 4) >= 5 AND page_id % 6 > 0""")
def staged_run(spark, sf_dir):
    """All stages for a board on each page: links are read, filtered by title, fetched, filtered by text, stored; a second run adds nothing."""
    rows, k = owned(spark, sf_dir), F.col("page_id")
    root = F.concat(F.lit("https://"), F.col("own"), F.lit(".fr"))
    boards = rows.select(F.concat(root, F.lit("/careers")).alias("board_url"), F.col("own").alias("company"), F.lit(None).cast("string").alias("ats"), F.lit(None).cast("string").alias("final_url"), F.lit(LINKS).alias("html"))
    text = F.concat(F.lit("<html><body><main>Work"), F.repeat(F.lit(" cook deck"), (k % 4).cast("int")), F.when(k % 6 == 0, F.lit(" idiot")).otherwise(F.lit("")), F.lit("</main></body></html>"))
    paths = F.explode(F.array(*[F.lit(p) for p in ("/jobs/41-ship-cook", "/jobs/42-deck-hand", "/jobs/43-second-mate")]))
    fetches = rows.select(root.alias("root"), text.alias("body"), paths.alias("path")).select(F.concat("root", "path").alias("url"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("request_body"), F.lit(200).alias("status"), "body")
    settings = pipeline.Settings(stream_folder(spark), ["cook", "deck", "hand", "ship"], ["idiot"], materialise(boards, "boards"), materialise(fetches, "fetches"))
    pipeline.run(spark, settings)
    pipeline.run(spark, settings, "detail", "store")
    return spark.read.parquet(settings.path("job_data")).select("url", "company", "title", "description")


LINKS = '<a href="/jobs/41-ship-cook">Ship Cook</a><a href="/jobs/42-deck-hand">Deck Hand</a><a href="/jobs/43-second-mate">Second Mate</a><a href="/about">About us</a>'


@query(rf"""SELECT page_id, regexp_replace(split_part(url, '#', 1), '/+$', '') AS norm, {HOST.format('url')} AS host, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS anchors FROM pages WHERE html LIKE '%<a href=%'""")
def functions_in_sql(spark, sf_dir):
    """Registered functions and a table function in one SQL statement over the pages."""
    registered.register(spark)
    return spark.sql(
        "SELECT page_id, norm_url(url) AS norm, host_of(url) AS host, anchors FROM {pages} JOIN (SELECT page_id AS id, count(*) AS anchors FROM {pages} p, LATERAL html_anchors(p.html, p.url) GROUP BY page_id) ON page_id = id",
        pages=table(spark, sf_dir, "pages").select("page_id", "url", "html"),
    )
