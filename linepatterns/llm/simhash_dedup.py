"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 (seed 42) of the text's shingles of ``width``
words, repeats included. Two texts are linked if their fingerprints differ in at most two bits.

Candidates. The fingerprint is cut into segments of 22, 21 and 21 bits. With two differing bits over three segments, at
least one segment is equal, and any other differs in two bits at most. The (23, 12) Golay code is perfect: each 23-bit word
lies within three bits of exactly one of its 4,096 codewords. The codewords of a word and of its 23 neighbours number one
or six, and two words that differ in two bits at most have one in common, that of the word between them. So a fingerprint
is filed, for each of its segments in turn, under that segment as it is and each codeword near the next one: up to 18 keys.
Keys are counted with partial sums; a fingerprint that has no company under any key has no link and goes.

Join and verification. Two fingerprints within two bits of each other have a meeting point within one bit of both, and two
that share such a point are within two bits. So each candidate is filed under the 65 points within one bit of it, a point
has at most 65 fingerprints, and a star at each point keeps all components exactly. There is no pairing inside a key,
however many fingerprints share it. Copies share a fingerprint and are never expanded into pairs.

Given a similarity in per cent instead, texts are linked if the Jaccard similarity of their sets of shingles is that or more.
Then fingerprints are filed under the same keys and joined on them, and the texts of each pair are compared as sets
(``alike_by_keys``). Under a key of more than ``_shingles.BUCKET`` texts each is paired with one of them. Texts that are 0.8 alike
differ in some ten bits of 64, so many share no key: ``_shingles`` finds the links between the components left, exactly.

Rows meet the label of their fingerprint by a join. Fingerprints of more than a thousandth of all rows are fewer than
1,000, so their labels are broadcast; the others are shuffled.

Nulls and texts without words have fingerprint zero and are linked like any other. A null id is never the smallest; a
component of null ids alone has a null component_id. Repeated rows are separate rows with equal results.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepatterns.llm import _shingles
from linepatterns.llm._words import LOWER, bit_table, checkpointed, labelled, on_plain_names
from linepatterns.llm.graph import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0xAE3


def fingerprint(text: bytes | None, width: int = 3) -> int:
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < width:
        return xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip((end - size)[: n - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)], "<u8")
    place = hashes.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256
    ones = np.bincount(place.ravel(), minlength=2048).reshape(8, 256) @ _byte_bits()
    return int(np.packbits(ones.ravel() * 2 > n - width + 1, bitorder="little").view("<u8")[0])


@cache
def _byte_bits() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 3) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a long, a row for each row."""
    base = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))

    def take(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t, width) for t in batch.column("_text").cast(pa.binary()).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id, "fp"])

    return base.mapInArrow(take, f"`{id}` {base.schema["_id"].dataType.simpleString()}, fp long")


def syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= np.where(word >> bit & 1, GENERATOR << (bit - 11), 0)
    return word


@cache
def _errors() -> np.ndarray:
    """The error of at most three bits that each of the 2,048 syndromes stands for."""
    one = 1 << np.arange(23)
    two = np.array([a | b for i, a in enumerate(one) for b in one[:i]])
    three = np.array([a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]])
    errors = np.concatenate([[0], one, two, three])
    table = np.empty(2048, np.int64)
    table[syndrome(errors)] = errors
    return table


def golay_index(word: np.ndarray) -> np.ndarray:
    """The message (12 bits) of the codeword nearest to each 23-bit word."""
    return (word ^ _errors()[syndrome(word)]) >> 11


def golay_keys(word: np.ndarray) -> np.ndarray:
    """Codewords of each word and of its 23 neighbours, sorted along the last axis; repeats are -1."""
    keys = np.sort(golay_index(word[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def _file(name: str = "fp"):
    """(``name``, key) of rows with fp."""

    def take(batches):
        for batch in batches:
            fp, own = np.asarray(batch.column("fp")).view(np.uint64), batch.column(name)
            for lo in range(0, len(fp), 20_000):
                part = fp[lo : lo + 20_000]
                segment = [(part >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
                for i in range(3):
                    keys = golay_keys(segment[(i + 1) % 3])
                    row, at = np.nonzero(keys >= 0)
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(row + lo)), pa.array((segment[i][row] * 3 + i) << 12 | keys[row, at])], names=[name, "key"])

    return take


def links(fps: DataFrame) -> DataFrame:
    """Different fingerprints (``fp``) -> edges (a, b) within two bits that keep every component of the links whole."""
    filed = fps.mapInArrow(_file(), "fp long, key long")
    shared = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    near = checkpointed(filed.join(shared, "key").select("fp").distinct())
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b))
    points = near.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), bits)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    return met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()


def alike_by_keys(prints: DataFrame) -> DataFrame:
    """(sig, fp) -> pairs (a, b) of sigs whose fingerprints share a key: all under one of few sigs, under another each with the smallest."""
    filed = checkpointed(prints.select("sig", "fp").mapInArrow(_file("sig"), "sig long, key long"))
    sized = filed.groupBy("key").agg(F.count("*").alias("m"), F.min("sig").alias("least")).where("m > 1")
    met = checkpointed(filed.join(sized, "key"))
    few = met.where(F.col("m") <= _shingles.BUCKET)
    pairs = few.select("key", F.col("sig").alias("a")).join(few.select("key", F.col("sig").alias("b")), "key").where("a < b").select("a", "b")
    stars = met.where((F.col("m") > _shingles.BUCKET) & (F.col("sig") != F.col("least"))).select(F.col("least").alias("a"), F.col("sig").alias("b"))
    return checkpointed(pairs.unionByName(stars).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 3, similar: int | None = None) -> DataFrame:
    """``id``, fp (with ``similar``: sig, a hash of the set of shingles) and component_id (the smallest id that links reach, its own included), a row for each row."""
    if similar is not None:
        rows = checkpointed(_shingles.signatures(docs, text, id, width, fingerprint))
        best = _best(docs, rows, text, width, similar)
        return labelled(rows.select("_id", "sig"), best, "sig", rows.count()).select(F.col("_id").alias(id), "sig", F.col("_best._id").alias("component_id"))
    prints = checkpointed(fingerprints(docs, text, id, width))
    firsts = prints.groupBy("fp").agg(F.min(id).alias("first"), F.count("*").alias("n"))
    roots = components(links(firsts.select("fp")))
    grouped = firsts.join(roots, firsts["fp"] == roots["node"]).groupBy("root").agg(F.min("first").alias("first"))
    moved = roots.join(grouped, "root").select(F.col("node").alias("fp"), F.col("first").alias("reached"))
    label = checkpointed(firsts.join(moved, "fp", "left").select("fp", "n", F.when(F.col("reached").isNull(), F.col("first")).otherwise(F.col("reached")).alias("component_id")))
    return labelled(prints, label, "fp", prints.count()).select(id, "fp", "component_id")


def _best(docs: DataFrame, rows: DataFrame, text: str, width: int, similar: int) -> DataFrame:
    """(sig, n, _best): rows of a set, and the first row of its component: (_null, _id, _key), ordered by id, nulls last, then by a hash of the text."""
    firsts = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min(F.struct(F.col("_id").isNull().alias("_null"), "_id", "_key")).alias("_first"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("bins").alias("bins"))
    firsts = checkpointed(firsts)
    roots = _shingles.links(docs, firsts.select("sig", "size", "bins"), text, width, similar, alike_by_keys(firsts.select("sig", "fp")))
    named = firsts.join(roots, firsts["sig"] == roots["node"], "left").select("sig", "n", "_first", F.coalesce("root", "sig").alias("root"))
    return checkpointed(named.join(named.groupBy("root").agg(F.min("_first").alias("_best")), "root").select("sig", "n", "_best"))


def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = 5, similar: int = 80) -> DataFrame:
    """``docs``, all columns, whatever their names, with one row of each group of near duplicates: the smallest id, nulls last, then the smallest hash of the text, then any of equal rows."""
    return on_plain_names(docs, lambda d, t, i: _one_of_each(d, t, i, width, similar), text, id)


def _one_of_each(docs: DataFrame, text: str, id: str, width: int, similar: int) -> DataFrame:
    rows = checkpointed(_shingles.signatures(docs, text, id, width, fingerprint))
    met = labelled(rows.select("_id", "_key", "sig"), _best(docs, rows, text, width, similar), "sig", rows.count())
    own = F.struct(F.col("_id").isNull().alias("_null"), "_id", "_key")
    each = met.groupBy("_id", "_key").agg(F.count("*").alias("_rows"), F.first(own.eqNullSafe(F.col("_best"))).alias("_stays"))
    touched = checkpointed(each.where("_rows > 1 or not _stays").select(F.col("_id").alias("__id"), F.col("_key").alias("__key"), "_stays"))
    is_touched = bit_table(touched, F.xxhash64("__id", "__key"))(F.xxhash64(F.col(id), F.xxhash64(F.col(text))))  # most rows stay as they are and need no join
    same = F.col(id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__key"))
    some = docs.where(is_touched)
    again = some.join(touched.where("_stays"), same).dropDuplicates(["__id", "__key"]).select(*(docs[c] for c in docs.columns))
    return docs.where(~is_touched).unionByName(some.join(touched, same, "left_anti")).unionByName(again)
