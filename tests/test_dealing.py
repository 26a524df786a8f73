"""Evidence is capped in tasks whose size does not grow with the table."""

import duckdb
from pyspark.sql import functions as F

from gleanwork import queries
from gleanwork.operators import dealing, detect

SF = "/root/testdata/sf0.001"


def test_tasks_of_capped_scores_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", 200)
    scored = queries.queries()["capped_scores"](spark, SF).withColumn("task", F.spark_partition_id())
    sizes = [r.n for r in scored.groupBy("task").agg(F.sum("n_evidence").alias("n")).collect()]
    assert sum(sizes) > 5_000 and max(sizes) < 400
    sql = duckdb.sql(queries.oracle_sql()["capped_scores"].replace("FROM lineitem", f"FROM '{SF}/lineitem.parquet'")).fetchall()
    assert sorted(sql) == sorted(tuple(r) for r in scored.select("page_id", "ats", "score", "n_evidence").collect())


def test_a_task_for_each_core_at_least(spark):
    assert dealing.dealt(spark.range(10), 10, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert dealing.dealt(spark.range(0), 0, "id").count() == 0
    assert dealing.dealt(spark.range(10), dealing.ROWS_PER_TASK * 50 + 1, "id").rdd.getNumPartitions() == 51


def test_dealing_changes_no_points(spark, monkeypatch):
    monkeypatch.setattr(dealing, "ROWS_PER_TASK", 5)
    rows = [(i % 7 if i < 200 else None, "ab"[i % 2], "xyz"[i % 3], (i * 37) % 251, i % 40) for i in range(251)]
    fired = spark.createDataFrame(rows, "page_id int, ats string, source string, rule_idx int, points int")
    dealt, plain = (sorted(map(str, detect.capped_points(fired, rows=n).collect())) for n in (len(rows), None))
    assert dealt == plain and 0 < len(dealt) < len(rows)


def test_scores_stay_where_evidence_was_dealt(spark):
    rows = [(i % 300, "ab"[i % 2], i % 2, "wxyz"[i % 4] if i % 5 else None, i % 4 or None, 10) for i in range(3_000)]
    evidence = spark.createDataFrame(rows, "page_id int, ats string, ats_idx int, source string, tier int, allowed long")
    found = detect.scores(evidence.repartition(37, "page_id")).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in found}) > 20  # not the session's four
    for r in found:
        own = [x for x in rows if (x[0], x[1]) == (r.page_id, r.ats)]
        counts = [len({x[3] for x in own if x[3] and (t is None or (x[4] or 9) <= t)}) for t in (None, 1, 2)]
        assert [r.sources, r.tier1, r.tier2] == counts and r.score == min(100, 10 * len(own))
