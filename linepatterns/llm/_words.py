"""Vectorised word handling shared by the operators that run numpy inside Spark tasks.

Texts are taken in chunks of about a megabyte, or less where that is said, so memory does not depend on the size of a batch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.sources.shared import shared_folder

CHUNK = 1 << 20
#: For stages of the pipeline: a chunk needs some sixty times its size, and a worker keeps what it has once taken.
SMALL_CHUNK = 1 << 17
HOT = 1000
LONG = 64
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SEPARATORS = bytes([*range(9, 14), 32])
#: Java's class for the same separators
WORD_GAP = r"[\x20\x09-\x0D]+"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def on_plain_names(docs: DataFrame, step: Callable[..., DataFrame], *columns: str) -> DataFrame:
    """``step`` of ``docs`` with its columns named c0, c1 ... and the new names of ``columns``; what it returns, rows of the same columns, gets the old names back. So no name can clash with those that steps use."""
    names = docs.columns
    place = {n.lower(): i for i, n in reversed(list(enumerate(names)))} | {n: i for i, n in reversed(list(enumerate(names)))}
    return step(docs.toDF(*(f"c{i}" for i in range(len(names)))), *(f"c{place[c] if c in place else place[c.lower()]}" for c in columns)).toDF(*names)


def labelled(rows: DataFrame, labels: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` with the other columns of ``labels``: a label for each key, and n, the rows of that key. Rows without a label go.

    Keys of more than n_rows / HOT rows, fewer than HOT in all, are broadcast, so none of them is dealt to one task.
    """
    own = [c for c in labels.columns if c not in (key, "n")]
    hot = F.broadcast(labels.where(F.col("n") * HOT > n_rows).select(F.col(key).alias("_hot"), F.struct(*own).alias("_label")))
    met = rows.join(hot, rows[key] == F.col("_hot"), "left").drop("_hot")
    few = met.where("_label is null").drop("_label").join(labels.where(F.col("n") * HOT <= n_rows).drop("n"), key)
    return met.where("_label is not null").select(*rows.columns, "_label.*").unionByName(few)


def bit_table(keys: DataFrame, hashed: Column, bits: int = 1 << 22) -> Callable[[Column], Column]:
    """A test whether a hash may be among those of ``keys``; a table of fixed size, so it only spares work and never decides."""
    place = F.pmod(hashed, F.lit(bits))
    set_bits = keys.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("b"))
    none = keys.sparkSession.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("b"))
    every = set_bits.unionByName(none).groupBy("at").agg(F.bit_or("b").alias("b"))
    table = checkpointed(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "b"))), lambda x: x["b"]).alias("table"))).scalar()

    def may_hold(value: Column) -> Column:
        p = F.pmod(value, F.lit(bits))
        return F.call_function("shiftrightunsigned", F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return may_hold


class _Powers:
    """base ** 0, 1, 2 ... modulo 2 ** 64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.have = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.have) < n:
            self.have = np.concatenate([self.have, self.have * np.uint64(pow(self.base, len(self.have), 1 << 64))])
        return self.have[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INV)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Prefix sums that give the hash of any range of a sequence in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _UP(n), out=self.sums[1:])
        self.down = _DOWN(n + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


class Chunk:
    """Some documents of a batch: ``first`` is the row of the first; word ``i`` of document ``d`` is at ``at[d] + i``."""

    __slots__ = ("at", "buf", "ends", "first", "ids", "starts", "texts")

    def __init__(self, first: int, texts: list[bytes], table: np.ndarray, lower: bool):
        self.first, self.texts = first, texts
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.translate(LOWER)
        self.buf = np.frombuffer(joined, np.uint8)
        word = np.zeros(len(joined) + 1, np.int8)
        np.take(table, self.buf, out=word[1:])
        step = np.diff(word)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.ids = Sums(_BYTE_VALUES[self.buf]).of(self.starts, self.ends)
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.at = np.searchsorted(self.starts, edges)


def canonical(text: bytes | None) -> bytes:
    """The words joined by one space. Words of more than ``LONG`` bytes are replaced by a digest that is longer than that too, so no other word equals it."""
    words = (text or b"").split()  # on the separators: bytes.split() knows just these six
    if len(text or b"") > LONG and max(map(len, words), default=0) > LONG:
        words = [b"\0" * (LONG - 16) + blake2b(w, digest_size=16).hexdigest().encode() if len(w) > LONG else w for w in words]
    return b" ".join(words)


def word_table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], np.int8)


SPACED = word_table(lambda b: b not in SEPARATORS)


def chunks(texts: list[bytes | None], table: np.ndarray = SPACED, lower: bool = False, most: int = CHUNK) -> Iterator[Chunk]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or b"") > most:
            yield Chunk(lo, [x or b"" for x in texts[lo:i]], table, lower)
            lo, size = i, 0
        size += len(t or b"")
    if lo < len(texts):
        yield Chunk(lo, [x or b"" for x in texts[lo:]], table, lower)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_names(words: np.ndarray, window: int) -> np.ndarray:
    """A number for each run of ``window`` words: equal numbers for equal words.

    By doubling, as the levels of a suffix tree: a run of 2d words is a pair of runs of d words.
    """
    name, depth = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while depth < window:
        step = min(depth, window - depth)
        pair = name[: len(name) - step] * (len(words) + 1) + name[step:]
        name, depth = np.unique(pair, return_inverse=True)[1].astype(np.int64), depth + step
    return name
