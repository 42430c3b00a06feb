"""Ranks over a whole table, without a window that gathers it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.sources.shared import free_name, written


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with each row's place in ``order``, from 1 on, as ``name``; its rows come in that order.

    Rows are dealt by ranges of ``order``, sorted within them, and written; a row's rank is its place in its partition plus the rows of
    the partitions before. Only one count for each partition reaches the driver. Rows that are equal in ``order`` stand in one partition in
    any order, so ``order`` should end with something that tells rows apart if a large part of them may be equal.
    """
    at = free_name(df.columns, "place")
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), 33)  # the number of the partition stands above the place in it
    counts = sorted(map(tuple, rows.groupBy(part.alias("part")).count().collect()))
    before = accumulate((n for _, n in counts), initial=0)
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], f"{at}_part long, {at}_before long")
    found = rows.join(F.broadcast(offsets), part == F.col(f"{at}_part"))
    rank = F.col(f"{at}_before") + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return found.select(*(rows[c] for c in df.columns if c != name), rank.alias(name))
