"""Filter passes, caps and dedupe on inline rows."""

import pytest

from gleanwork.functions import text
from gleanwork.operators import filters

RAW = "company string, title string, url string"
DETAILED = "company string, title string, url string, description string"
WORDS = ["rust", "embedded", "firmware", "can bus"]


def kept_by_first(spark, rows, keywords, blacklist=(), **options):
    return filters.first_filter(spark.createDataFrame(rows, RAW), keywords, blacklist, **options).collect()


#: (title, url) and whether it passes with WORDS and the blacklist ["volunteer"]
JUDGED = {
    "two words in the title": ("Embedded rust programmer", "https://hire.example/p/1", True),
    "one in the title, one in the url": ("Firmware tester", "https://hire.example/p/rust-team", True),
    "words of several parts and any letter case": ("CAN Bus and FIRMWARE", "https://hire.example/p/2", True),
    "one word is too few": ("Rust removal", "https://hire.example/p/3", False),
    "a part of a word is none": ("Rusty embeddedness", "https://hire.example/p/4", False),
    "a blacklisted title": ("Volunteer embedded rust programmer", "https://hire.example/p/5", False),
    "a blacklisted url without a title": ("", "https://hire.example/jobs/volunteer/77120", False),
    "no title to judge by": ("", "https://hire.example/jobs/77121", True),
    "a title of other things": ("Florist", "https://hire.example/jobs/77122", False),
}


def test_first_filter(spark):
    rows = [(name, title, url) for name, (title, url, _) in JUDGED.items()]
    found = {r.company for r in kept_by_first(spark, rows, WORDS, ["volunteer"])}
    assert found == {name for name, (_, _, passes) in JUDGED.items() if passes}


def test_accents_fold_by_case_only(spark):
    rows = [("a", "Électricien ÉOLIEN", "u"), ("b", "electricien eolien", "v")]
    assert [r.company for r in kept_by_first(spark, rows, ["électricien", "éolien"])] == ["a"]


def test_blank_titles_are_read_from_the_url_before_they_are_judged(spark):
    rows = [("a", " ", "https://hire.example/jobs/embedded-rust-intern/4410"), ("b", None, "https://hire.example/jobs/head-florist/4411")]
    assert [(r.company, r.title) for r in kept_by_first(spark, rows, WORDS)] == [("a", "Embedded Rust Intern")]


def test_the_cap_holds_for_unjudged_rows_only(spark):
    rows = [("big", "", f"https://big.example/jobs/{i}") for i in range(40)] + [("big", "Embedded rust", f"https://big.example/x/{i}") for i in range(25)]
    rows += [("small", None, f"https://small.example/jobs/{i}") for i in range(4)] + [(None, "", "https://lost.example/jobs/1"), (None, "Embedded rust", "https://lost.example/x")]
    runs = [sorted((str(r.company), r.title or "", r.url) for r in kept_by_first(spark, rows[::step], WORDS, most_unjudged=7)) for step in (1, -1)]
    assert runs[0] == runs[1]  # whatever the order of rows
    count = lambda company, title: sum(c == company and t == title for c, t, _ in runs[0])
    assert (count("big", ""), count("big", "Embedded rust"), count("small", "")) == (7, 25, 4)
    assert (count("None", ""), count("None", "Embedded rust")) == (0, 1)


def test_without_keywords_only_the_blacklist_counts(spark):
    assert [r.company for r in kept_by_first(spark, [("a", "Volunteer", "u"), ("b", "Florist", "v"), ("c", None, None)], [], ["volunteer"])] == ["b", "c"]


@pytest.mark.parametrize(
    ("title", "description", "hits"),
    [
        ("Rust programmer", "Embedded work: firmware, a can bus and more firmware.", 5),
        ("Rust programmer", "Embedded work.", None),  # two of five
        ("", "Embedded firmware in rust.", 3),  # three are enough without a title
        ("Rust embedded firmware can bus rust", " ", None),  # nothing was fetched
        ("Rust", "Embedded firmware, can bus, rust. For a volunteer.", None),
    ],
)
def test_second_filter(spark, title, description, hits):
    df = spark.createDataFrame([("a", title, "https://hire.example/p", description)], DETAILED)
    assert [r.keyword_hits for r in filters.second_filter(df, WORDS, ["volunteer"]).collect()] == ([] if hits is None else [hits])


def test_words_that_end_in_a_sign_need_the_other_boundary(spark):
    df = spark.createDataFrame([("we use f# here",), ("f#minor",)], "t string")
    assert [r.h for r in df.select(text.keyword_hits(["t"], ["f#"]).alias("h")).collect()] == [0, 1]
    assert [r.h for r in df.select(text.keyword_hits(["t"], ["f#"], "lookaround").alias("h")).collect()] == [1, 0]


def test_dedupe_keeps_the_first_of_each_address(spark):
    rows = [(9, "https://hire.example/p/1#top"), (3, "https://hire.example/p/1"), (5, "https://hire.example/p/1//"), (4, "https://hire.example/p/2"), (1, None), (2, None)]
    once = filters.dedupe(spark.createDataFrame(rows, "pos int, url string"))
    assert sorted(r.pos for r in once.collect()) == [1, 2, 3, 4]
    assert sorted(r.pos for r in filters.dedupe(once).collect()) == [1, 2, 3, 4]


def test_empty_tables(spark):
    assert filters.first_filter(spark.createDataFrame([], RAW), WORDS, ["x"]).count() == 0
    assert filters.second_filter(spark.createDataFrame([], DETAILED), WORDS, []).count() == 0
    assert filters.dedupe(spark.createDataFrame([], "pos int, url string")).count() == 0


def test_broken_urls_have_titles_too(spark):
    from gleanwork.functions.urls import title_from_url

    df = spark.createDataFrame([(x,) for x in ("", "::", "https://", "////", "https://hire.example/%zz%", None)], "url string")
    assert all(r.t is not None for r in df.select(title_from_url("url").alias("t")).collect())
