"""Connected components by alternating large and small stars, each a few aggregations and equi-joins.

Nothing is gathered in one task: a node's smallest neighbour is a partial aggregation, and the join that hands it to the
neighbours is one that Spark can split. Each round is checkpointed. Rounds end when every node has one edge, to its root, so edges that
are stars already take none; a stage that calls this several times starts from the stars of the call before (``stars``). The driver keeps
figures of every stage and task and threads of every exchange, so rounds are kept few and short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepatterns.llm._words import checkpointed


def stars(roots: DataFrame) -> DataFrame:
    """What ``components`` gave as edges again."""
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _all_stars(now: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or one and a larger one."""
    ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), longs that are not null -> (node, root): the smallest node of each component, for nodes with an edge."""
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = checkpointed(small.distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
