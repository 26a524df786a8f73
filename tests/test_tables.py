"""Tables with versions, stored signals, rules as keys, keyed streams, schemas, selection by ranks, links."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import json_schema
from gleanwork.operators import detect, graph, reports, rules
from gleanwork.plans.registry import all_rules
from gleanwork.sources import connectors
from gleanwork.sources.signal_store import SignalStore
from gleanwork.sources.versioned import Conflict, VersionedTable
from gleanwork.streaming import keyed

SCHEMA = "url string, n long"


def rows_of(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=repr)


def test_versions_and_first_rows(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    assert table.version() == 0 and table.read().count() == 0
    batch = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 5), ("b", 9)], SCHEMA)
    assert table.insert_new(batch, "url", "n") == (4, 1)
    assert table.insert_new(spark.createDataFrame([("a", 0), ("c", 3), ("", 1)], SCHEMA), "url", "n") == (2, 1)
    assert rows_of(table, 1) == [("a", 1), ("b", 9), (None, 5), (None, 5)]
    assert rows_of(table) == sorted([("a", 1), ("b", 9), (None, 5), (None, 5), ("c", 3), ("", 1)], key=repr)
    assert table.append_once(batch, "epoch-1") and not table.append_once(batch, "epoch-1") and table.version() == 3


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    table.append(spark.createDataFrame([("a", 1)], SCHEMA))
    bad = spark.range(100).select(F.col("id").cast("string").alias("url"), F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("n"))
    with pytest.raises(Exception, match="broken"):
        table.insert_new(bad, "url", "n")
    assert rows_of(table) == [("a", 1)] and table.version() == 1 and table.vacuum() == 0


def test_two_writers_from_one_version(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    one = spark.createDataFrame([("a", 1), ("b", 1)], SCHEMA)
    table.append(one, base=0)
    with pytest.raises(Conflict):
        table.append(one, base=0)
    rivals = [spark.createDataFrame([("b", 7), ("c", 7)], SCHEMA), spark.createDataFrame([("d", 8)], SCHEMA)]

    def others():
        if rivals:
            VersionedTable(spark, table.path, SCHEMA).insert_new(rivals.pop(0), "url", "n")

    assert table.insert_new(spark.createDataFrame([("c", 2), ("d", 2), ("e", 2)], SCHEMA), "url", "n", before_publish=others) == (1, 2)
    assert rows_of(table) == [("a", 1), ("b", 1), ("c", 7), ("d", 8), ("e", 2)] and table.vacuum() == 0


def test_signals_are_parsed_once(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://jobs.lever.co/x", "<p>a</p>"), (2, "https://jobs.lever.co/x", "<p>a</p>"), (3, None, None), (4, "https://a.b/", "<title>t</title>")], "page_id long, url string, html string")
    store = SignalStore(spark, f"file://{tmp_path}/s")
    assert store.refresh(pages) == {"pages": 4, "parsed": 3} and store.refresh(pages) == {"pages": 4, "parsed": 0}
    assert store.refresh(pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit("<i>")))) == {"pages": 4, "parsed": 3}
    stored = {r.page_id: (r.status, r.score) for r in detect.detect_signals(store.signals(pages)).collect()}
    assert stored == {r.page_id: (r.status, r.score) for r in detect.detect(pages).collect()} and stored[1] == ("detected", 60)


def test_path_literals_are_in_all_matches():
    samples = ["/job/oslo/x/", "/a/jobs/12", "/jobs/1/b/job", "/sf/recruiting/", "/careersection/2/jobdetail.ftl", "/x/jobsearch.ftl", "/a/0a1b2c3d-1111-2222-3333-444455556666", "/careers/jobs/3-x/applications/new", "/api/feeds/offers", "/a/j/b", "/careers/5", "/api/v2/applicants", "/jobs/a/b/c/d", "/p/ff", "/job/4", "/xml", "/en-gb/jobs/4/", "/postings.json", "/api/v1/jobs", "/a/job/b-c", "/apply/a1", "/feeds/export/jobs/"]
    paths = [r for r in all_rules() if r.kind == "path"]
    for r in paths:
        met = [s for s in samples if re.search(r.what, s, re.IGNORECASE)]
        assert met and all(rules.anchor_of(r.what) in s for s in met), r
    keys = {(k[0], k[1]) for k in rules.rule_keys()}
    assert {("path", rules.anchor_of(r.what)) for r in paths} <= keys


def test_literals_that_overlap(spark):
    words = ["powered by icims", "icims", "jobs/", "/jobs/"]
    found = spark.range(1).select(rules.found_literals(F.lit("x powered by icims /jobs/ icims"), words).alias("f")).first().f
    assert sorted(found) == sorted(words)


def test_first_rows_of_keys_in_a_stream(spark, tmp_path):
    schema = "k string, n long"
    target = VersionedTable(spark, f"file://{tmp_path}/t", keyed.stored_schema(spark.createDataFrame([], schema).schema))
    for batch in ([("a", 3), ("b", 2), ("a", 1), (None, 0)], [("a", 0), ("c", 5)], [("b", 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        keyed.insert_stream(spark, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), target, f"{tmp_path}/state", "k", "n")
    assert sorted((r.k, r.n, r.id) for r in target.read().collect()) == [("a", 1, 1), ("b", 2, 2), ("c", 5, 1)]


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [5.0] * 9, [float(i % 7) for i in range(500)], [random.Random(1).gauss(0, 1e6) for _ in range(5000)], [0.0] * 3000 + [1e9] * 2999 + [-4.0]])
def test_exact_median(spark, monkeypatch, values):
    monkeypatch.setattr(reports, "LAST_VALUES", 100)
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4)
    assert reports.mean_median(rows, "v").first()["median"] == statistics.median(values)


def test_median_of_nothing(spark):
    assert tuple(reports.mean_median(spark.createDataFrame([(None,)], "v double"), "v").first()) == (None, None)


def test_links_with_cycles_and_a_budget(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("a", None), ("a", "b")], "source string, target string")
    seeds = spark.createDataFrame([("a",), ("e",), (None,)], "node string")
    found = {(r.start, r.node): r.depth for r in graph.reachable(links, seeds, 9).collect()}
    assert found == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 2, ("a", "e"): 3, ("e", "e"): 0}
    assert {r.node for r in graph.reachable(links, seeds.where("node = 'a'"), 9, budget=3).collect()} == {"a", "b", "c"}


def test_schema_reasons(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["b"], "properties": {"b": {"type": "number", "minimum": 0}}}}, "c": {"type": "boolean"}}}
    cases = {
        '{"a": [{"b": 1.5}]}': [], '{"a": []}': ["$.a: fewer than 1 items"], "[]": ["$: not an object"], "{": ["$: no JSON"], None: ["$: no JSON"], "{}": ["$.a: missing"], '{"a": null}': ["$.a: missing"],
        '{"a": [{"b": -1}, {"b": -2}, {}, 5], "c": 1}': ["$.a[].b: below 0", "$.a[].b: missing", "$.a[]: not an object", "$.c: not a boolean"], '{"a": [{"b": 2}], "c": true}': [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "body string").select("body", json_schema.reject_reasons("body", schema).alias("r"), json_schema.parsed("body", schema).alias("p"))
    for r in rows.collect():
        assert r.r == cases[r.body] and (r.p is not None) == (not cases[r.body])


def test_xml_records(spark):
    body = '<?xml version="1.0"?><!-- x --><a:r xmlns:a="u"><p k="1"><n> <![CDATA[a<b]]> </n><o/></p><p><n>x &amp; y</n><o>z</o><deep><n>no</n></deep></p></a:r>'
    rows = spark.createDataFrame([(1, body), (2, "<r><p>"), (3, None), (4, ""), (5, "<r/>"), (6, "plain")], "id long, body string")
    found = connectors.xml_records(rows, "p", ["n", "o", "deep.n"]).orderBy("pos").collect()
    assert [(r.id, r.pos, r.item_n, r.item_o, r["item_deep.n"]) for r in found] == [(1, 0, "a<b", None, None), (1, 1, "x & y", "z", "no")]


def test_element_attributes_beyond_the_limit_do_not_count():
    from gleanwork.functions import html

    found = html.page_signals("".join(f'<a id="i{i}" href="/{i}"></a>' for i in range(20_001)), "https://a.fr/")
    assert len(found["ids"]) == 20_000 and len(found["anchor_urls"]) == 500
