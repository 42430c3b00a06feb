"""Target-distribution importance resampling in two Arrow passes.

Texts are lower-cased (A-Z only) and cut into words of digits, letters and everything beyond ASCII. Features are the words and the pairs of
neighbouring words, joined by one space, repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.

First pass: each partition of the raw and of the target texts adds its features up in one vector with np.bincount; treeReduce merges
the vectors, so the driver gets one for each table. From them comes a gain for each bucket,
floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), where s of the raw table's S features and t of the target's T are in it.
Second pass: the gains, ``buckets`` numbers, are broadcast; features gather theirs, and np.bincount with them as weights adds up each document.

A document's weight is the floored mean of its gains (0 without features), its score the weight plus a Gumbel variate in thousandths, which
SHA-256 of the seed and the id fixes. Of the N documents with ``least_words`` words or more, ``percent`` * N // 100 are drawn: those with the
highest scores, ties to the smaller id. Ranks come from a sort by ranges, so no task gets all documents.

Null and empty texts have no features, weight 0 and a score, and are never drawn. Null ids hash as no digits and come last among ties.
Repeated rows have equal scores, and their order among themselves is arbitrary. Empty tables have S or T = 0. Extra columns are left out,
whatever their names. Texts are read a megabyte at a time, so memory does not follow their length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.llm._words import checkpointed
from linepatterns.operators.ranks import ranked

PIECE = 1 << 20
FULL = 1 << 20
#: Bytes of words as they are, A-Z lower-cased, all others as spaces.
_FLAT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_hashes(text: bytes) -> Iterator[list[int]]:
    """CRC-32 of each word and of each pair of neighbouring words of a text, a piece of the text at a time."""
    flat, at, before = text.translate(_FLAT), 0, None
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        words = flat[at : end if end >= 0 else len(flat)].split()
        at = end if end >= 0 else len(flat)
        if words:
            own = [crc32(w) for w in words]
            first = [] if before is None else [crc32(b" " + words[0], before)]
            yield own + first + [crc32(b" " + w, c) for w, c in zip(words[1:], own, strict=False)]
            before = own[-1]


def features(texts: list[bytes | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of all features, about ``FULL`` at a time; a long document's stand in several."""
    hashes: list[int] = []
    docs, sizes = [], []
    for i, text in enumerate(texts):
        for found in feature_hashes(text or b""):
            hashes += found
            docs.append(i)
            sizes.append(len(found))
            if len(hashes) >= FULL:
                yield np.repeat(docs, sizes), np.array(hashes, np.int64) % buckets
                hashes, docs, sizes = [], [], []
    if hashes:
        yield np.repeat(docs, sizes), np.array(hashes, np.int64) % buckets


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("_text").cast(pa.binary()).to_pylist()


def _counting(buckets: int) -> Callable:
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket in features(_texts(batch), buckets):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return count


def bucket_counts(texts: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Features by bucket of a whole table: a vector for each partition, merged as a tree."""
    vectors = texts.select(F.col(text).alias("_text")).mapInArrow(_counting(buckets), "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both models, floored, a whole number for each bucket."""
    buckets, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weighing(shared, buckets: int) -> Callable:
    def weigh(batches):
        gains = shared.value
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for doc, bucket in features(_texts(batch), buckets):
                lo, hi = doc[0], doc[-1] + 1
                n[lo:hi] += np.bincount(doc - lo, minlength=hi - lo)
                total[lo:hi] += np.bincount(doc - lo, gains[bucket], hi - lo).astype(np.int64)  # whole numbers far below 2 ** 53
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["_id", "n_features", "weight"])

    return weigh


def gumbel(id: Column, seed: int) -> Column:
    """A Gumbel variate in thousandths, floored, from the leading 32 bits of SHA-256 of ``seed:id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def resample(docs: DataFrame, targets: DataFrame, text: str = "text", id: str = "doc_id", target_text: str = "text", buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``id``, n_features, weight, score and rank (from 1 on in the order of the draw, null if not drawn), a row for each row of ``docs``."""
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(targets, target_text, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    base = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    weighed = base.mapInArrow(_weighing(shared, buckets), f"_id {base.schema['_id'].dataType.simpleString()}, n_features long, weight long")
    scored = checkpointed(weighed.withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed)).withColumn("_row", F.monotonically_increasing_id()))
    enough = F.col("n_features") >= 2 * least_words - 1  # w words and w - 1 pairs
    drawn = ranked(scored.where(enough), F.desc("score"), F.asc_nulls_last("_id"), "_row")
    most = drawn.count() * percent // 100
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("_id").alias(id), "n_features", "weight", "score", "rank")
