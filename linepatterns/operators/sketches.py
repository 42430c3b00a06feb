"""Counts by hash slot in arrays of a fixed size, and the test whether a slot is frequent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def slots_of(values: Column, size: int) -> Column:
    """The slot of each value of an array."""
    return F.transform(values, lambda v: F.pmod(F.xxhash64(v), F.lit(size)).cast("int"))


def _merged(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(a.astype(np.int64) + b, most).astype(a.dtype)


def frequent_slots(slots: DataFrame, size: int, support: int) -> np.ndarray:
    """Which of ``size`` slots occur ``support`` times or more. slots: one column, an array of slots in each row.

    Each partition counts in an array of ``size`` numbers, arrays are merged as a tree, and one of them reaches the driver. Counts stop at
    ``support``, so their numbers are as narrow as that allows: a byte each below 255.
    """
    most = min(support, (1 << 62) - 1)
    kind = np.min_scalar_type(max(most, 0))

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(total, most).astype(kind).tobytes()], pa.binary())], names=["counts"])

    parts = slots.mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], kind))
    total = parts.treeReduce(lambda a, b: _merged(a, b, most)) if parts.getNumPartitions() else np.zeros(size, kind)
    return total >= support


def as_bits(spark: SparkSession, frequent: np.ndarray) -> Column:
    """The slots as one array of 64-bit numbers, for ``holds``."""
    words = np.packbits(np.pad(frequent, (0, -len(frequent) % 64)), bitorder="little").view(np.int64)
    return spark.createDataFrame([(words.tolist(),)], "bits array<long>").scalar()


def holds(bits: Column, hashed: Column, size: int) -> Column:
    slot = F.pmod(hashed, F.lit(size))
    return F.call_function("shiftrightunsigned", F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
