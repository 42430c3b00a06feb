"""Ranks over a whole table."""

import random

from pyspark.sql import functions as F

from linepatterns.operators.ranks import ranked


def test_ranks_are_those_of_a_sort(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(20)]), rng.choice("abc")) for i in range(2000)]
    df = spark.createDataFrame(rows, "_place long, a int, B string").repartition(7)
    got = ranked(df, F.desc_nulls_last("a"), "B", "_place").collect()  # with the name of a column it uses itself
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert [tuple(r) for r in got] == [(*r, i + 1) for i, r in enumerate(want)]


def test_ranks_of_nothing_of_ties_and_of_a_ranked_table(spark):
    assert ranked(spark.createDataFrame([], "a int"), "a").collect() == []
    same = spark.createDataFrame([(1,)] * 50, "a int").repartition(4)
    assert sorted(r["n"] for r in ranked(same, "a", name="n").collect()) == list(range(1, 51))
    again = spark.createDataFrame([(3, 9), (1, 9), (2, 9)], "a int, rank long")
    assert [tuple(r) for r in ranked(again, F.desc("a")).collect()] == [(3, 1), (2, 2), (1, 3)]
