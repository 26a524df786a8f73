"""Row functions hold slices of a batch, not whole ones, and give what plain calls give."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanwork.functions import html as H
from gleanwork.functions import jsonx as J
from gleanwork.functions.batches import SLICE_BYTES, SLICE_ROWS, slices
from gleanwork.sources import fetches as FT


def parts_of(udf, *columns):
    """Lengths of the arrays in which a UDF gives back one batch."""
    return [len(x) for x in udf.func(iter([columns if len(columns) > 1 else columns[0]]))]


def test_slices_hold_few_rows_and_bytes():
    assert list(slices((pa.array(["x"] * 130),))) == [(0, SLICE_ROWS), (64, SLICE_ROWS), (128, 2)]
    big = "x" * (SLICE_BYTES // 2 + 1)
    assert list(slices((pa.array(["a", big, big, None, "b"]), pa.array([1, 2, 3, 4, 5])))) == [(0, 2), (2, 3)]
    assert list(slices((pa.array([b"x" * 3 * SLICE_BYTES, b"y"]),))) == [(0, 1), (1, 1)]
    assert list(slices((pa.array([], pa.string()),))) == []


PAGES = pa.array(['<a id="i" href="/1">go</a>', None] * 500)
URLS = pa.array(["https://x.example/"] * 1000)


@pytest.mark.parametrize(
    ("udf", "columns"),
    [
        (H.extract_page, (PAGES, URLS)), (H.html_anchors, (PAGES, URLS)), (H.extract_detail, (PAGES,)), (H.html_unescape_twice, (PAGES,)),
        (J.feed_items, (pa.array(['{"a": [{"id": 1, "t": "x"}]}'] * 1000), *[pa.array([x] * 1000) for x in ("a", "t", "p")], pa.nulls(1000))),
        (FT.text_of_bytes, (pa.array([b"x", None] * 500), pa.array([None] * 1000, pa.string()))),
    ],
)
def test_results_go_back_by_slices(udf, columns):
    found = parts_of(udf, *columns)
    assert sum(found) == 1000
    assert max(found) == SLICE_ROWS


def test_values_of_all_kinds(spark):
    page = '<title>T</title><meta name="k" content="v"><b data-x="1" data-y="2" class="c d">x</b>'
    rows = spark.createDataFrame([(i, page if i % 3 else None) for i in range(200)], "i long, html string").repartition(1)
    found = rows.select("i", H.extract_page("html", F.lit("https://x.example/")).alias("p")).select("i", "p.meta", "p.data_attrs", "p.classes", "p.text", "p.is_job_page").orderBy("i").collect()
    assert len(found) == 200
    for r in found:
        full = r.i % 3 > 0
        assert r.meta == ({"title": "T", "k": "v"} if full else {})
        assert r.data_attrs == ({"data-x": ["1"], "data-y": ["2"]} if full else {})
        assert (r.classes, r.text, r.is_job_page) == ((["c", "d"], "T x", False) if full else ([], "", False))
