"""Importance resampling: documents drawn by how much likelier the target's n-gram model makes them than the raw corpus's.

Features are words and pairs of neighbouring words (A-Z lower-cased), hashed to ``buckets``. Both models are multinomials
over the buckets with add-one smoothing. The raw model counts every row, the target model every target row. A row's log ratio is the sum over its features of log(target / raw); its
key is that plus a Gumbel variate, which a hash of its id, text and the seed fixes. The ``k`` largest keys are selected
(``share`` of the rows that have words, rounded down), exactly, by counting keys in ever finer ranges and ranking only the rows
of the last range, 10,000 at most unless their keys are equal.

Nulls and texts without words have log ratio and key null and are never selected. Ties on the key are broken by id and text hash;
repeated rows have equal keys. Without target rows the ratio is that of a uniform target. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepatterns.llm._words import SPACED, Sums, checkpointed, chunks


BROADCAST = 1_000_000


def features(c, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each feature of a chunk."""
    doc = np.repeat(np.arange(len(c.texts)), np.diff(c.at))
    size = np.uint64(buckets)
    if len(c.ids) < 2:
        return doc, (c.ids % size).astype(np.int64)
    at = np.flatnonzero(doc[1:] == doc[:-1])
    pair = Sums(c.ids).of(at, at + 2)
    return np.concatenate([doc, doc[at]]), np.concatenate([c.ids % size, pair % size]).astype(np.int64)


def _counts(buckets: int):
    def count(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            target = np.asarray(batch.column("_target").to_pylist(), bool)
            for c in chunks(batch.column("_text").cast(pa.binary()).to_pylist(), SPACED, lower=True):
                doc, bucket = features(c, buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[target[doc + c.first]], minlength=buckets)
        at = np.flatnonzero(total[0])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])

    return count


def _ratios(shared, buckets: int):
    def score(batches):
        weights = shared.value
        for batch in batches:
            out: list[np.ndarray] = []
            for c in chunks(batch.column("_text").cast(pa.binary()).to_pylist(), SPACED, lower=True):
                doc, bucket = features(c, buckets)
                n = np.bincount(doc, minlength=len(c.texts))
                out.append(np.where(n > 0, np.bincount(doc, weights[bucket], len(c.texts)), np.nan))
            ratio = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(ratio, mask=np.isnan(ratio))], names=["_id", "_key", "log_ratio"])

    return score


def resample(docs: DataFrame, target_ids: DataFrame, text: str = "text", id: str = "doc_id", share: float = 0.1, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """``id``, log_ratio, gumbel_key and selected, a row for each row. target_ids: one column, the ids of the trusted rows."""
    base = docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    spark = docs.sparkSession
    wanted = target_ids.toDF("_id").where("_id is not null").distinct().withColumn("_target", F.lit(True))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    marked = base.join(wanted, "_id", "left").select("_text", F.coalesce("_target", F.lit(False)).alias("_target"))
    counts = np.ones((2, buckets))
    for r in marked.mapInArrow(_counts(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        counts[:, r[0]] += r[1:]
    weights = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    kind = base.schema["_id"].dataType.simpleString()
    scored = base.mapInArrow(_ratios(spark.sparkContext.broadcast(weights), buckets), f"_id {kind}, _key long, log_ratio double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("gumbel"), F.col("_id"), F.col("_key")), 11).cast("double") + 0.5) / float(1 << 53)
    scored = checkpointed(scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(uniform))))
    return top(scored, "gumbel_key", share, ["_id", "_key"]).select(F.col("_id").alias(id), "log_ratio", "gumbel_key", "selected")


def top(df: DataFrame, key: str, share: float, ties: list[str], ranges: int = 4096, border: int = 10_000) -> DataFrame:
    """``df`` with ``selected``: whether ``key`` (null: never) is among the largest ``share`` of those that are not null.

    Keys are counted in ``ranges`` equal parts of an interval, and the part in which the last place falls becomes the next
    interval, until it holds at most ``border`` rows or a single value. Only its rows are ranked; ties are ordered by ``ties``.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    k = int(n * share)
    if not k:
        return df.withColumn("selected", F.lit(False))
    above, held = 0, n
    while held > border and low < high:
        inside = df.where(F.col(key).between(low, high))
        part = F.least(F.floor((F.col(key) - low) / (high - low) * ranges), F.lit(ranges - 1))
        before = (low, high)
        for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("part")).collect():  # at most ``ranges`` rows
            if above + r["n"] >= k:
                low, high, held = r["low"], r["high"], r["n"]
                break
            above += r["n"]
        if (low, high) == before:  # as fine as doubles go
            break
    edge = df.where(F.col(key).between(low, high)).withColumn("selected", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(key), *ties)) <= k - above)
    rest = df.where(~F.coalesce(F.col(key).between(low, high), F.lit(False))).withColumn("selected", F.coalesce(F.col(key) > high, F.lit(False)))
    return edge.unionByName(rest)
