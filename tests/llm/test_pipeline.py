"""The pipeline and the operators' registered SQL on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from gleanwork.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert seen[1] <= seen[0] and seen[2] <= seen[1] and seen[3] == seen[2] and seen[4] == seen[5] > 0


@pytest.mark.parametrize("rows", [
    [],
    [(1, "one line of words " * 20, "en", "a", 1, "x"), (1, "one line of words " * 20, "en", "a", 1, "x"), (None, None, None, None, None, None), (2, "", None, "a", 0, "y"), (None, " ".join(f"w{i}" for i in range(90)), "en", None, 3, "z")],
])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    """Nulls, repeats, empty tables and a further column whose name the stages use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() == sum(r[3] is None and r[1] is not None for r in rows) * docs.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = queries.queries()[name](spark, SF)
    names = sorted(found.columns)
    result = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    assert sorted(repr([r[c] for c in names]) for r in found.collect()) == sorted(repr([dict(zip(columns, r, strict=True))[c] for c in names]) for r in result.fetchall())
