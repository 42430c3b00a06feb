"""Line keys, candidates and their gap envelopes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.config import MinerConfig
from linepatterns.operators import sketches
from linepatterns.operators.vocabulary import exploded


def known_words(frequent: DataFrame, config: MinerConfig) -> pa.Array | None:
    """The frequent words, if they are counted at ``broadcast_words`` and ``broadcast_bytes`` or fewer."""
    n, size = frequent.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    if n > config.broadcast_words or (size or 0) > config.broadcast_bytes:
        return None
    return frequent.select("word").toArrow().column("word").combine_chunks()


def _keyed(batch: pa.RecordBatch, known: pa.Array, rewrite: bool) -> pa.RecordBatch:
    """Each line's frequent words in order and its gaps, worked out for all words of a batch at once."""
    lists = batch.column("words")
    at = np.asarray(lists.offsets).astype(np.int64)
    place = pc.index_in(lists.flatten(), value_set=known)
    if rewrite:
        place = pc.coalesce(place, pc.index_in(batch.column("news").flatten(), value_set=known))
    at -= at[0]
    pos = np.flatnonzero(np.asarray(place.is_valid()))
    row = np.searchsorted(at, pos, "right") - 1
    each = np.bincount(row, minlength=len(batch))
    local = pos - at[row]
    first = np.concatenate([[True], np.diff(row) != 0])[: len(row)]
    before = np.where(first, -1, np.concatenate([[0], local[:-1]])[: len(row)])
    some = np.flatnonzero(each)  # lines with a constant
    gaps = np.empty(len(pos) + len(some), np.int32)
    last = np.cumsum(each[some]) - 1
    ends = last + 1 + np.arange(len(some))
    gaps[ends] = np.diff(at)[some] - local[last] - 1
    gaps[np.delete(np.arange(len(gaps)), ends)] = local - before - 1
    offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    words = pa.ListArray.from_arrays(offsets(each), known.take(place.filter(place.is_valid())))
    spans = pa.ListArray.from_arrays(offsets(np.where(each > 0, each + 1, 0)), pa.array(gaps))
    return pa.RecordBatch.from_arrays([batch.column("line_id"), batch.column("line"), words, spans], names=["line_id", "line", "constants", "gaps"])


def line_keys(tokens: DataFrame, frequent: DataFrame, known: pa.Array | None, config: MinerConfig, rewrite: bool | None = None) -> DataFrame:
    """(line_id, line, constants, gaps): a line's frequent words in order, and the numbers of other words before each and after the last; empty for lines without any.

    With the frequent words at hand each line is mapped where it stands and nothing is shuffled. Otherwise frequent words are joined, and
    shuffled by line.
    """
    use = config.rewrites if rewrite is None else rewrite
    if known is not None:
        words = tokens.sparkSession.sparkContext.broadcast(known)

        def take(batches):
            for batch in batches:
                yield _keyed(batch, words.value, use)

        return tokens.mapInArrow(take, f"line_id {tokens.schema['line_id'].dataType.simpleString()}, line string, constants array<string>, gaps array<int>")
    known_rows = frequent.select("word")
    rows = exploded(tokens, use)
    if use:
        rows = rows.join(known_rows.select(F.col("word").alias("_own"), F.col("word").alias("own")), F.col("word") == F.col("_own"), "left")
        rows = rows.join(known_rows.select(F.col("word").alias("_new"), F.col("word").alias("changed")), F.col("new") == F.col("_new"), "left")
        rows = rows.select("line_id", "n_words", "pos", F.coalesce("own", "changed").alias("word")).where("word is not null")
    else:
        rows = rows.join(known_rows, "word", "left_semi")
    keys = rows.groupBy("line_id").agg(F.max("n_words").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("at"))  # as many as a line has words
    gaps = F.transform("at", lambda x, i: x["pos"] - F.coalesce(F.get("at", i - 1)["pos"], F.lit(-1)) - 1)
    tail = F.col("n") - F.get("at", F.size("at") - 1)["pos"] - 1
    keys = keys.select("line_id", F.transform("at", lambda x: x["word"]).alias("constants"), F.concat(gaps, F.array(tail)).alias("gaps"))
    none = lambda kind: F.array().cast(kind)
    return tokens.select("line_id", "line").join(keys, "line_id", "left").select("line_id", "line", F.coalesce("constants", none("array<string>")).alias("constants"), F.coalesce("gaps", none("array<int>")).alias("gaps"))


def counted_keys(keys: DataFrame) -> DataFrame:
    """(constants, gaps, support, first_line_id): lines by key. All that candidates, co-occurrence and weights need of the lines."""
    return keys.groupBy("constants", "gaps").agg(F.count("*").alias("support"), F.min("line_id").alias("first_line_id"))


def envelope(rows: DataFrame, key: str) -> DataFrame:
    """(key, gap_min, gap_max, support, own_support, first_line_id) of rows with key, gap_min, gap_max, support and first_line_id.

    Most keys have one row and are done. Of the others, gaps are aggregated by place, so no key's rows are ever gathered, and a key is not
    repeated for each of its places but for those that have several gaps to compare.
    """
    whole = rows.groupBy(key).agg(F.count("*").alias("_rows"), F.min("gap_min").alias("gap_min"), F.min("gap_max").alias("gap_max"), F.sum("support").alias("support"), F.min("first_line_id").alias("first_line_id"))
    many = whole.where("_rows > 1").select(F.col(key).alias("_many"))
    each = rows.join(many, rows[key] == F.col("_many"), "left_semi").select(key, F.posexplode(F.arrays_zip("gap_min", "gap_max")).alias("i", "g"))
    each = each.groupBy(key, "i").agg(F.min("g.gap_min").alias("lo"), F.max("g.gap_max").alias("hi"))
    ends = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("_g")).withColumnRenamed(key, "_many")
    found = whole.join(ends, whole[key] == F.col("_many"), "left")
    low = F.coalesce(F.transform("_g", lambda x: x["lo"]), F.col("gap_min"))
    high = F.coalesce(F.transform("_g", lambda x: x["hi"]), F.col("gap_max"))
    return found.select(key, low.alias("gap_min"), high.alias("gap_max"), "support", F.col("support").alias("own_support"), "first_line_id")


def candidates(counted: DataFrame, config: MinerConfig, kept: Column | None = None) -> DataFrame:
    """(constants, n_constants, gap_min, gap_max, support, own_support, first_line_id) from counted keys. kept: a sketch's frequent slots; keys of other slots go."""
    if kept is not None:
        counted = counted.where(sketches.holds(kept, F.xxhash64("constants"), config.csize))
    rows = counted.select("constants", F.col("gaps").alias("gap_min"), F.col("gaps").alias("gap_max"), "support", "first_line_id")
    return envelope(rows, "constants").withColumn("n_constants", F.size("constants"))


def outliers(keys: DataFrame, clusters: DataFrame) -> DataFrame:
    """(line_id, line): lines without constants, and lines whose constants are no cluster's. Clusters are broadcast if Spark finds them small."""
    return keys.join(clusters.select("constants"), "constants", "left_anti").select("line_id", "line")
