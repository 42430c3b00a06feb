"""What each filter removes in every order of application: depth-first through the trie of orders, a state for each set of filters.

The trie's root holds all documents; an edge applies one more filter. Which documents survive depends on the set of filters applied, not on their
order, so each set is visited once, by the first path that comes to it, and the 2 ** n states stand for all n! paths. A state's survivors
are its parent's without those that fail the edge's filter, persisted while its children are visited and then released: n - 1 tables are
held at most. In each state the documents that the next filters remove are counted in one pass and written, for each part.

Filters are judged on the documents as they come, each once, before the walk. Survivors are a row for each document of flags and part, without text;
they come from a table in the shared folder, so a lost executor costs what it held. All that reaches the driver is the
list of filters. Orders times parts are joined to the counts of their edges, zeros included.

Null texts are empty; null parts are the empty string. A document without words has no repeated words, and passes C. Repeats (E) are judged by SHA-256
of the whole text, on all rows: a document fails if a row with a smaller id has the same text; null ids are smaller than none
and never fail. Rows that repeat with their id are documents of their own, and the first of them passes with all its twins. Labels: a document is good
or toxic if any of its labels says so; null ids have no labels. Empty tables have no parts and no rows. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import uuid
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.llm._words import WORD_GAP, checkpointed, labelled, let
from linepatterns.sources.shared import shared_folder


def failures(text: Column) -> dict[str, Column]:
    """Filters that a text decides by itself: A few words, B few different words, C capitals, D symbols."""
    few = lambda words: F.struct((F.size(words) < 200).alias("A"), (100 * F.size(F.array_distinct(words)) < 50 * F.size(words)).alias("B"))
    by_words = let(F.array_remove(F.split(text, WORD_GAP, -1), ""), few)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"by_words": by_words, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    """(part, good, toxic, A, B, C, D, E): of each document its part, labels and which filters it fails. labels: (``id``, quality, toxic)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = failures(whole)
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(source), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("_digest"), *(c.alias(k) for k, c in found.items()))
    rows = checkpointed(rows.select("_id", "part", "_digest", "by_words.A", "by_words.B", "C", "D"))
    firsts = checkpointed(rows.groupBy("_digest").agg(F.count("*").alias("n"), F.min("_id").alias("_first")))
    rows = labelled(rows, firsts, "_digest", rows.count()).withColumn("E", F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))).drop("_digest", "_first")
    known = labels.select(F.col(id).alias("_label"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("_label is not null").groupBy("_label").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    met = rows.where("_id is not null").join(known, F.col("_id") == F.col("_label"), "left").drop("_label")
    met = met.unionByName(rows.where("_id is null"), allowMissingColumns=True)  # null ids would all go to one task of the join
    return met.select("part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), *"ABCDE")


def edges(documents: DataFrame, filters: str) -> DataFrame:
    """(part, state, filter, reached, removed, good_lost, toxic_lost) of each edge of the trie: state is the set of filters before it, as bits. Parts without survivors are left out."""
    folder = f"{shared_folder(documents.sparkSession)}/audit-{uuid.uuid4().hex}"
    seen: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        left = [i for i in range(len(filters)) if not state >> i & 1]
        counts = [F.count_if(F.col(filters[i]) & also).alias(f"{name}_{i}") for i in left for name, also in (("removed", F.lit(True)), ("good_lost", F.col("good")), ("toxic_lost", F.col("toxic")))]
        counted = survivors.groupBy("part").agg(F.count("*").alias("reached"), *counts)
        each = F.array(*(F.struct(F.lit(filters[i]).alias("filter"), *(F.col(f"{name}_{i}").alias(name) for name in ("removed", "good_lost", "toxic_lost"))) for i in left))
        counted.select("part", F.lit(state).alias("state"), "reached", F.inline(each)).write.mode("append").parquet(folder)
        for i in left:
            if state | 1 << i not in seen and len(left) > 1:
                child = survivors.where(~F.col(filters[i])).persist(StorageLevel.MEMORY_AND_DISK)
                visit(state | 1 << i, child)
                child.unpersist()

    root = documents.persist(StorageLevel.MEMORY_AND_DISK)
    visit(0, root)
    root.unpersist()
    return documents.sparkSession.read.parquet(folder)


def audit(documents: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """documents: part, good, toxic and a boolean for each filter, true if the document fails it.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order and step.
    """
    spark, n = documents.sparkSession, len(filters)
    bit = {f: 1 << i for i, f in enumerate(filters)}
    orders = [(i, "".join(p), k + 1, p[k], sum(bit[f] for f in p[:k])) for i, (p, k) in enumerate((p, k) for p in permutations(filters) for k in range(n))]
    orders = spark.createDataFrame(orders, "at int, filter_order string, step int, filter string, state int")  # n! * n rows, whatever the data
    found = checkpointed(edges(checkpointed(documents), filters))
    paths = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("state") + 1)  # orders that pass by an edge
    last = F.col("state") == sum(bit.values()) - F.element_at(F.create_map(*(F.lit(x) for f in filters for x in (f, bit[f]))), F.col("filter"))
    totals = found.groupBy("part", "filter").agg(F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("_fails"), F.sum(F.when(last, F.col("removed")).otherwise(0)).alias("unique_fails"), F.sum(F.col("removed") * paths).alias("shapley"))
    parts = found.where("state = 0").select("part").distinct()
    rows = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) * n - 1))).alias("at")).join(F.broadcast(orders), "at")
    rows = rows.join(found, ["part", "state", "filter"], "left").join(totals, ["part", "filter"])
    count = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    out = {"kept": count("reached") - count("removed"), "removed": count("removed"), "redundant": F.col("_fails") - count("removed"), "unique_fails": F.col("unique_fails")}
    out |= {"good_lost": count("good_lost"), "toxic_lost": count("toxic_lost"), "shapley": F.col("shapley")}
    return rows.select("part", "filter_order", "step", *(c.alias(k) for k, c in out.items()))
