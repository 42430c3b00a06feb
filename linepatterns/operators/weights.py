"""Word dependency, word weights, and clusters joined where their words are weak."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepatterns.operators.candidates import envelope
from linepatterns.sources.shared import written


def cooccurrence(candidates: DataFrame) -> DataFrame:
    """(w1, w2, n): lines with both words as constants, from candidates weighed by their own lines; w1 = w2 included."""
    rows = candidates.select(F.array_distinct("constants").alias("d"), "own_support")
    return rows.select(F.explode("d").alias("w1"), "d", "own_support").select("w1", F.explode("d").alias("w2"), "own_support").groupBy("w1", "w2").agg(F.sum("own_support").alias("n"))


def needed_pairs(clusters: DataFrame) -> DataFrame:
    """(word, other): different words that stand together in a cluster. Each pair stands once, at that of both that has fewer partners, so no word has many."""
    d = clusters.select(F.array_distinct("constants").alias("d"))
    pairs = written(d.select(F.explode("d").alias("word"), "d").select("word", F.explode("d").alias("other")).where("word < other").distinct())
    partners = pairs.select(F.explode(F.array("word", "other")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    of = lambda c: partners.select(F.col("w").alias(c), F.struct("n", "w").alias(f"n_{c}"))
    both = pairs.join(of("word"), "word").join(of("other"), "other")
    first = F.col("n_word") < F.col("n_other")
    return both.select(F.when(first, F.col("word")).otherwise(F.col("other")).alias("word"), F.when(first, F.col("other")).otherwise(F.col("word")).alias("other"))


def needed_cooccurrence(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """The rows of ``cooccurrence`` for words that stand together in a cluster, from all candidates.

    A candidate's words look up their partners, and those that the candidate holds too are kept. So it makes a row for each of its words and each pair
    that is needed, not for all pairs of its words.
    """
    pairs = needed_pairs(clusters)
    used = clusters.select(F.explode("constants").alias("word")).distinct()
    rows = written(candidates.select(F.monotonically_increasing_id().alias("id"), F.array_distinct("constants").alias("d"), "own_support"))
    words = rows.select("id", "own_support", F.explode("d").alias("word")).join(used, "word", "left_semi")
    own = words.groupBy("word").agg(F.sum("own_support").alias("n")).select(F.col("word").alias("w1"), F.col("word").alias("w2"), "n")
    asked = words.join(pairs, "word").select("id", "own_support", "word", "other")
    met = asked.join(words.select("id", F.col("word").alias("other")), ["id", "other"], "left_semi")
    n = met.groupBy("word", "other").agg(F.sum("own_support").alias("n"))
    both = n.select(F.explode(F.array(F.struct(F.col("word").alias("w1"), F.col("other").alias("w2"), "n"), F.struct(F.col("other").alias("w1"), F.col("word").alias("w2"), "n"))).alias("p"))
    return written(own.unionByName(both.select("p.*")))


def dependency(cooc: DataFrame) -> DataFrame:
    """(w1, w2, dep): the share of w1's lines that hold w2."""
    own = cooc.where("w1 = w2").select(F.col("w1").alias("_w"), F.col("n").alias("own"))
    return cooc.join(own, F.col("w1") == F.col("_w")).select("w1", "w2", (F.col("n") / F.col("own")).alias("dep"))


def word_weights(clusters: DataFrame, dep: DataFrame, function: int) -> DataFrame:
    """(constants, pos, word, weight). 1: mean dependency of the word on the cluster's words; 2: the same over its other different words."""
    rows = clusters.select("constants", F.posexplode("constants").alias("pos", "word"))
    others = rows.withColumn("w1", F.explode("constants" if function == 1 else F.array_distinct("constants")))
    rows = others.join(dep.select("w1", F.col("w2").alias("word"), "dep"), ["w1", "word"], "left").groupBy("constants", "pos", "word").agg(F.sum("dep").alias("total"), F.count("*").alias("k"))
    weight = F.col("total") / F.col("k") if function == 1 else F.when(F.col("k") == 1, 1.0).otherwise((F.col("total") - 1) / (F.col("k") - 1))
    return rows.select("constants", "pos", "word", weight.alias("weight"))


def join_clusters(clusters: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """(tokens, gap_min, gap_max, support, first_line_id, n_constants, n_members, is_joined); tokens: array of (words, is_token).

    Words below the threshold are masked; clusters that are equal but for masked words become one.
    """
    masks = weights.withColumn("kept", F.when(F.col("weight") >= threshold, F.col("word"))).groupBy("constants").agg(F.sort_array(F.collect_list(F.struct("pos", "kept"))).alias("m"))
    rows = clusters.join(masks, "constants").withColumn("mask", F.transform("m", lambda x: x["kept"])).drop("m")
    rows = rows.withColumn("is_joined", F.exists("mask", lambda w: w.isNull()))
    rows = rows.withColumn("key", F.struct("mask", "is_joined"))
    merged = envelope(rows, "key")
    words = rows.select("key", F.posexplode("constants").alias("pos", "word")).groupBy("key", "pos").agg(F.collect_set("word").alias("words"))
    words = words.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("tokens"))
    members = rows.groupBy("key").agg(F.count("*").alias("n_members"))
    out = merged.join(words, "key").join(members, "key")
    tokens = F.transform("tokens", lambda t, i: F.struct(t["words"].alias("words"), F.get("key.mask", i).isNull().alias("is_token")))
    own = ("gap_min", "gap_max", "support", "first_line_id", F.size("tokens").alias("n_constants"), "n_members", F.col("key.is_joined").alias("is_joined"))
    return out.select(tokens.alias("tokens"), *own)
