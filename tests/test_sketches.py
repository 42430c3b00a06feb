"""Sketches: which slots are frequent, that results do not depend on them, and that they spare shuffles."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bench import shuffled
from linepatterns.config import MinerConfig
from linepatterns.operators import sketches
from linepatterns.plans.catalogue import doc
from linepatterns.plans.miner import LineMiner

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("support", [0, 1, 3, 254, 255, 300, 70_000])
def test_frequent_slots(spark, support):
    rows = [[i % 7, i % 3, 11] for i in range(300)] + [[]] * 3
    df = spark.createDataFrame([(r,) for r in rows], "slots array<int>").repartition(9)
    n = Counter(x for r in rows for x in r)
    got = sketches.frequent_slots(df, 13, support)
    assert got.tolist() == [n[i] >= support for i in range(13)]
    assert sketches.frequent_slots(df.where("false"), 13, support).tolist() == [support <= 0] * 13
    bits = sketches.as_bits(spark, np.arange(200) % 3 == 0)
    assert [r["id"] for r in spark.range(200).where(sketches.holds(bits, F.col("id"), 200)).collect()] == list(range(0, 200, 3))


def mined(spark, **options):
    spark.catalog.clearCache()  # what other runs over the same lines still hold would be used again
    with LineMiner(doc(spark, SF), MinerConfig(support=5, **options)) as m:
        before = shuffled(spark)
        n = m.n_frequent
        words = shuffled(spark, before)
        before = shuffled(spark)
        found = sorted(tuple(r) for r in m.clusters.select("pattern", "support", "first_line_id").collect())
        keys = shuffled(spark, before)
        return n, m._counted.count(), found, words, keys, m.summary().first()


def test_sketches_spare_shuffles_of_documents(spark):
    n, words, found, shuffled_words, shuffled_keys, row = mined(spark)
    m, fewer, same, less_words, less_keys, other = mined(spark, wsize=200_000, csize=20_000)
    assert (n, found) == (m, same) and fewer < words / 3
    print(f"shuffle bytes: words {shuffled_words}, with a sketch {less_words}; keys {shuffled_keys}, with a sketch {less_keys}")
    assert less_words < shuffled_words and less_keys < shuffled_keys
    assert row["clusters"] == other["clusters"] == len(found) and row["outliers"] == other["outliers"] and other["word_slots"] >= n and other["candidate_slots"] >= len(found)
    assert other["candidates"] < row["candidates"]


def test_statistics_need_no_more_passes(spark):
    """A source that counts how often it is read: words, keys, and nothing more for the statistics."""
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        reads.add(1)
        yield from batches

    lines = doc(spark, SF).coalesce(1).mapInArrow(read, "line_id long, line string")
    with LineMiner(lines, MinerConfig(rsupport=0.05)) as m:
        row = m.summary().first()
        assert reads.value == 2 and row["outliers"] == m.outliers().count() and reads.value == 3
    with LineMiner(lines, MinerConfig(support=5, wfilter="^e", wsearch="[0-9]+", wreplace="N")) as m:
        assert m.summary().first()["outliers"] == m.outliers().count()
    with LineMiner(lines, MinerConfig(support=10**6)) as m:
        assert m.summary().first()["outliers"] == 0 and m.outliers().isEmpty()
