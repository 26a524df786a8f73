"""What can be reached over links, round by round with a visited set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.sources.shared import materialise


def reachable(links: DataFrame, seeds: DataFrame, depth: int, budget: int = 0) -> DataFrame:
    """``start, node, depth``: what each start reaches over ``source, target`` links, each node once with its least depth.

    Each round joins the last round's nodes with the links and leaves out what
    was visited, so cycles end. Rounds are written to the shared folder: plans
    stay short and lost executors cost one round. With a ``budget`` a start
    visits so many nodes at most; of a round that goes beyond it the first by
    name count. Null nodes are not followed.
    """
    links = links.select("source", "target").where("source is not null and target is not null").distinct()
    frontier = materialise(seeds.select(F.col("node").alias("start"), "node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "reached")
    rounds = [frontier]
    for d in range(1, depth + 1):
        visited = reduce(DataFrame.unionAll, rounds)
        step = frontier.join(links, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        step = step.join(visited.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d))
        if budget:
            spent = visited.groupBy("start").agg(F.count("*").alias("spent"))
            place = F.row_number().over(_by_start())
            step = step.join(spent, "start").withColumn("place", place + F.col("spent")).where(F.col("place") <= budget).select("start", "node", "depth")
        frontier = materialise(step, "reached")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    return reduce(DataFrame.unionAll, rounds)


def _by_start():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("start").orderBy("node")
