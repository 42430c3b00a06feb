"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets. A source's share is its weight's part of the total; none takes more than ``cap`` times its own size, and what is
over is shared again by weight until none is above. That ends at one water level w: each target is min(cap * size, w * weight).
With the sources in the order of cap * size / weight, those below the level come first, and running sums give the level.

Sampling. Each row is taken target // size whole times. The fraction that is left is filled with whole rows in the order
of a seeded hash of id and text: sizes are summed over 4,096 ranges of the hash, ranges below the border are taken, and the
range on the border is cut into 4,096 again, and those once more. Only rows of the last range on the border, one in 2 ** 36 of
a source, are ranked. So a source comes within one row of its target, no task gets a share of a source that grows in practice
(rows that repeat with their id share a hash and stay together), and reruns agree.

Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating, unless ``weights`` has them. Nulls and empty texts
have size 0 and are taken 0 times. Repeated rows are separate rows with an equal hash; which of them is taken at the border is
the same for the result. There is one row for each source in the plan's tables: they are broadcast up to ``BROADCAST`` sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepatterns.llm._words import WORD_GAP, checkpointed

BROADCAST = 10_000
LEVELS = 3


def targets(sources: DataFrame, cap: int) -> DataFrame:
    """(source, source_size, weight) -> the same with target. A row for each source."""
    rows = sources.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
    rows = rows.withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("source", "source_size", "weight", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mixture(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", weights: DataFrame | None = None, cap: int = 3, seed: int = 11) -> DataFrame:
    """``id``, source, _key (a hash of the text), size, source_size, target and taken, a row for each row. weights: (source, weight), positive."""
    sized = docs.select(F.col(id).alias("_id"), F.col(source).alias("source"), F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP, -1), "")).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("_key"))
    sized = checkpointed(sized.withColumn("_draw", F.xxhash64(F.lit(seed), "_id", "_key")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    else:
        given = weights.toDF("_source", "weight")
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "source_size", F.coalesce("weight", F.lit(1)).alias("weight"))
    plan = targets(sources, cap)
    plan = checkpointed(plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")))
    few = plan.count() <= BROADCAST
    small = lambda df: F.broadcast(df) if few else df
    same = F.col("source").eqNullSafe(F.col("_source"))
    place = lambda level: F.shiftrightunsigned("_draw", 64 - 12 * level)
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", "_whole", "_rest", F.lit(0).cast("long").alias("_border"), F.lit(0).cast("long").alias("_before"))  # _border: the range that holds the border, null if all rows are taken
    for level in range(1, LEVELS + 1):
        inside = sized.where("size > 0").join(small(plan), same)
        if level > 1:
            inside = inside.where(place(level - 1) == F.col("_border"))
        parts = inside.groupBy("source", place(level).alias("_part")).agg(F.sum("size").alias("_size"), F.first("_before").alias("_from"), F.first("_rest").alias("_rest"))
        parts = parts.withColumn("_upto", F.col("_from") + F.sum("_size").over(Window.partitionBy("source").orderBy("_part")))
        over = parts.where("_upto > _rest").groupBy("source").agg(F.min_by(F.struct("_part", (F.col("_upto") - F.col("_size")).alias("_before")), "_part").alias("_at"))
        border = over.select(F.col("source").alias("_s"), F.col("_at._part").alias("_border"), F.col("_at._before").alias("_before"))
        plan = checkpointed(plan.drop("_border", "_before").join(small(border), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"))
    rows = sized.join(small(plan), same).drop("_source").withColumn("_place", place(LEVELS))
    edge = rows.where("size > 0 and _place = _border").withColumn("_upto", F.sum("size").over(Window.partitionBy("source").orderBy("_draw", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("_more", (F.col("_before") + F.col("_upto") - F.col("size") / 2 <= F.col("_rest")).cast("long")).drop("_upto")
    rest = rows.where("not (size > 0 and _place <=> _border)").withColumn("_more", (F.coalesce(F.col("_place") < F.col("_border"), F.lit(True)) & (F.col("_rest") > 0)).cast("long"))
    return edge.unionByName(rest).select(F.col("_id").alias(id), "source", "_key", "size", "source_size", "target", ((F.col("_whole") + F.col("_more")) * F.col("size")).cast("long").alias("taken"))
