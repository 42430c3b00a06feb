"""Words counted together only where a cluster needs it."""

import random

from pyspark.sql import functions as F

from linepatterns.operators import weights


def test_needed_rows_are_those_of_all(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = list({tuple(rng.choices(words, k=rng.randint(1, 9))): None for _ in range(300)})
    found = spark.createDataFrame([(list(c), rng.randint(1, 5)) for c in rows], "constants array<string>, own_support long").repartition(4)
    clusters = spark.createDataFrame([(list(c),) for c in [*rows[:40], ("w1", "w1"), ("w2",)]], "constants array<string>")
    pairs = {(a, b) for c in [*rows[:40], ("w1",), ("w2",)] for a in c for b in c}
    got = {(r["w1"], r["w2"]): r["n"] for r in weights.needed_cooccurrence(found, clusters).collect()}
    full = {(r["w1"], r["w2"]): r["n"] for r in weights.cooccurrence(found).collect()}
    assert got == {p: n for p, n in full.items() if p in pairs}
    assert weights.needed_cooccurrence(found, clusters.where("false")).collect() == []


def test_a_pair_stands_at_the_word_with_fewer_partners(spark):
    clusters = spark.createDataFrame([(["hub", f"w{i}"],) for i in range(50)] + [(["hub", "w1", "w2"],)], "constants array<string>")
    found = {tuple(r) for r in weights.needed_pairs(clusters).select("word", "other").collect()}
    assert found == {(f"w{i}", "hub") for i in range(50)} | {("w1", "w2")}


def test_a_line_of_many_words_makes_few_rows(spark):
    """A candidate of 5,000 words has 25 million pairs of words; ten are needed."""
    many = spark.createDataFrame([([f"w{i}" for i in range(5000)], 3), (["w0", "w1"], 2)], "constants array<string>, own_support long")
    clusters = spark.createDataFrame([([f"w{i}" for i in range(0, 5)],)], "constants array<string>")
    out = weights.needed_cooccurrence(many, clusters)
    assert {(r["w1"], r["w2"]): r["n"] for r in out.collect()}["w1", "w0"] == 5 and out.agg(F.count("*")).first()[0] == 25
