"""Writes and joins of the store, and invariants of scores."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gleanwork.functions import jsonx, registered
from gleanwork.functions.html import detail_rungs, fragment_text, page_signals
from gleanwork.functions.text import interval_of
from gleanwork.operators import detect, documents, store


def test_insert_ignore_counts(spark):
    schema = "pos long, url string"
    old = spark.createDataFrame([(7, "u1"), (9, None)], "id long, url string")
    new = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u2"), (4, None), (5, None)], schema)
    rows = store.insert_ignore(old, new, ["pos"]).select("id", "pos").collect()
    assert sorted(tuple(r) for r in rows) == [(10, 2), (11, 4), (12, 5)]
    assert store.insert_counts(old, new, ["pos"]).collect()[0].asDict() == {"inserted": 3, "skipped": 2}
    assert store.insert_counts(old, new.where("pos < 0"), ["pos"]).collect()[0].asDict() == {"inserted": 0, "skipped": 0}


def test_limit_and_window_arguments():
    with pytest.raises(ValueError):
        store.limited(None, -1)
    assert interval_of("-24 hours") == "INTERVAL '-24' HOUR"
    with pytest.raises(ValueError):
        interval_of("soon")


def test_blank_keys_are_never_done(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,)], "url string")
    assert sorted(str(r.url) for r in store.without_done(rows, rows).collect()) == ["", "None"]


def test_migration_twice(spark):
    from pyspark.sql import functions as F

    old = spark.createDataFrame([(1,)], "id long")
    once = store.migrated(old, {"timestamp": F.lit("t")})
    assert store.migrated(once, {"timestamp": F.lit("u")}).collect()[0].timestamp == "t"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("ab"), st.sampled_from("xy"), st.integers(0, 60)), min_size=1, max_size=30))
def test_scores_are_capped(spark, rows):
    fired = spark.createDataFrame([(p, a, 0, s, i, n, 1) for i, (p, a, s, n) in enumerate(rows)], "page_id int, ats string, ats_idx int, source string, rule_idx int, points int, tier int")
    kept = detect.capped_points(fired)
    for r in kept.groupBy("page_id", "ats", "source").sum("allowed").collect():
        assert 0 < r["sum(allowed)"] <= 70
    scored = detect.scores(kept)
    assert all(r.score <= 100 for r in scored.collect())
    assert all(0 <= r.confidence <= 1 for r in detect.verdicts(scored).collect())


def test_html_text_leaves_out_scripts_and_furniture():
    html = "<body><nav>Menu</nav><p>One<b>two</b><script>x</script></p><style>s</style><p>three<br>four"
    assert detail_rungs(html)["body"] == "One\ntwo\nthree\nfour"
    assert page_signals(html, "https://a")["text"] == "Menu One two three four"
    assert len(fragment_text("<p>" + "a" * 300_000)) == 20_000
    assert fragment_text(None) == fragment_text("  ") == ""


def test_json_walks_stop_at_depth():
    deep = "x"
    for _ in range(20):
        deep = [deep]
    assert jsonx.first_string(deep) is None
    assert list(jsonx.walk_postings({"@type": ["Thing", "JobPosting"], "a": {"@type": "JobPosting"}}))[1] == {"@type": "JobPosting"}


def test_unknown_placeholder_fails(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([({"A": "x"},)], "strings map<string,string>")
    assert df.select(documents.resolved(F.lit("{A} {A}"), F.col("strings")).alias("t")).collect()[0].t == "x x"
    with pytest.raises(Exception, match="B"):
        df.select(documents.resolved(F.lit("{A} {B}"), F.col("strings"))).collect()


def test_model_answers_and_documents(spark):
    def backend(model, prompt):
        if prompt == "bad":
            raise OSError
        return json.dumps({"adequation_grade": 80 if prompt == "good" else 180, "depth_analysis": model})

    out = documents.call_model(spark.createDataFrame([("good",), ("bad",), ("high",)], "prompt string"), backend, "m")
    found = {r.prompt: r.verdict for r in documents.parse_verdicts(out).collect()}
    assert found["good"].adequation_grade == 80 and found["bad"] is None and found["high"] is None
    lines = documents.cv_lines(spark.createDataFrame([(1, json.dumps({"cv_introduction": "i", "profile_text": "p", "skills": [], "experiences": [], "education": []}))], "id long, cv string"))
    assert bytes(documents.render_docx(lines).collect()[0].docx)[:2] == b"PK"
    assert documents.pdf_bytes(b"x", program="no-such-program") is None


def test_functions_in_sql(spark):
    registered.register(spark)
    row = spark.sql("SELECT norm_url('https://a/b/#c') n, is_blank(' nan ') b, host_of('https://A.b:80/c') h, html_unescape('&amp;') u, ascii_slug('é b') s").collect()[0]
    assert tuple(row) == ("https://a/b", True, "a.b", "&", "e_b")
    assert spark.sql("""SELECT url FROM html_anchors('<a href="/x">y</a>', 'https://a')""").collect()[0].url == "https://a/x"
    assert spark.sql("""SELECT title FROM json_jobpostings('{"@type":"JobPosting","title":"T"}')""").collect()[0].title == "T"


def test_templates_are_filled(spark):
    from gleanwork.operators import templates

    lines = [("", "Ann Lee ☀")] + [("", f"{{{t}}}") for t in documents.TOKENS] + [("", "{LANG}")]
    template = documents.docx_bytes(lines)
    blocks = {t: [("Head", " rest"), ("", "• one")] for t in documents.TOKENS}
    made = templates.fill(template, blocks, {"LANG": "French"})
    df = spark.createDataFrame([(made,)], "content binary")
    found = df.select(templates.docx_paragraphs("content").alias("p")).collect()[0].p
    assert found[0] == "Ann Lee " and found[1:3] == ["Head rest", "• one"] and found[-1] == "French"
    assert templates.fill(template, blocks, {"LANG": "French"}) == made
    with pytest.raises(ValueError, match="LANG"):
        templates.fill(template, blocks, {})
    with pytest.raises(ValueError, match="PROFILE_TEXT"):
        templates.fill(documents.docx_bytes(lines[:2]), blocks, {})


def test_deduplicated_stream_gets_all_events(spark, monkeypatch):
    from gleanwork import queries

    monkeypatch.setattr(queries.incremental, "deduplicated_stream", lambda stream, *_: stream)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert queries.queries()["deduplicated_stream"](spark, "/root/testdata/sf0.001").count() == events


def test_deduplicated_stream_inside_and_beyond_the_window(spark, tmp_path):
    import time

    from gleanwork.streaming import incremental

    files = [[("a", "01 00"), ("a", "01 12"), ("b", "01 00")], [("b", "01 13"), ("c", "05 00")], [("d", "05 05")], [("a", "05 06"), ("c", "05 10")]]
    for rows in files:
        df = spark.createDataFrame(rows, "k string, t string").selectExpr("k", "to_timestamp('2024-01-' || t, 'yyyy-MM-dd HH') AS t")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = incremental.run_to_end(incremental.deduplicated_stream(stream, "k", "t"), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    assert sorted(r.k for r in found) == ["a", "a", "b", "c", "d"]  # "a" comes again four days after its state has ended
