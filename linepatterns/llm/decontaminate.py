"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z only). A window is ``window`` consecutive words of a benchmark item; an item of fewer words, but
not none, is one window. Each word of a document inside any occurrence of a window is hit.

Fingerprints. Winnowing keeps, of the ``window - GRAM + 1`` hashes of ``GRAM``-word runs in each window, the smallest (all of
them, if several are). What is kept depends on the window's words alone, so a document that holds a window holds its
fingerprint too: no shared span of a window or more is missed. Items shorter than a window have the hash of all their words.

Join. The different fingerprints of each document are joined with the items'. A bit table of ``MARKS`` bits, set by the
items' fingerprints, tells most others beforehand; it changes what is shuffled, never the result. The items' fingerprints
are broadcast if they are counted at ``BROADCAST`` or fewer, else Spark shuffles both sides.

Extension. Documents that share a fingerprint meet the texts of those items, and the words are compared themselves: equal
windows get equal names by doubling (one word, two, four ...), so the work grows with the length of the texts, not with
how often a word repeats. What is hit rests on words, never on hashes.

Nulls have no words. Items with a null id mark words but are not listed; repeated items count once. Repeated rows (equal id
and text) have equal results, null ids included. Clashing names do no harm: columns used inside begin with an underscore,
and of ``docs`` only ``keep`` and the text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.llm._words import LOWER, SMALL_CHUNK, Sums, checkpointed, chunks, on_plain_names, sliding_min, window_names, word_table

GRAM = 8
MARKS = 1 << 22
BROADCAST = 200_000
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] on bytes, after lower-casing
LETTERS = word_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").translate(LOWER))


def winnow(ids: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash is the smallest of a window inside one document, and the hashes of all places."""
    place = np.arange(len(ids) - GRAM + 1)
    h = Sums(ids).of(place, place + GRAM) | np.uint64(1)
    wide = window - GRAM + 1
    least = sliding_min(h, wide)
    doc_end = np.repeat(at[1:], np.diff(at))[: len(least)]
    least = np.where(np.arange(len(least)) + window <= doc_end, least, 0)
    pad = np.zeros(wide - 1, np.uint64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF) - sliding_min(np.uint64(0xFFFFFFFFFFFFFFFF) - np.concatenate([pad, least, pad]), wide)
    return np.flatnonzero(most[: len(h)] == h), h


def _prints(c, window: int, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(document, fingerprint) of a chunk: winnowed ones, and the hashes at each place of the lengths in ``short``."""
    ids, at = c.ids, c.at
    doc = np.repeat(np.arange(len(c.texts)), np.diff(at))
    docs, prints = [], []
    if len(ids) >= window:
        keep, h = winnow(ids, at, window)
        docs.append(doc[keep])
        prints.append(h[keep])
    for n in short:
        p = np.arange(max(0, len(ids) - n + 1))
        p = p[p + n <= at[doc[p] + 1]]
        docs.append(doc[p])
        prints.append(Sums(ids).of(p, p + n))
    return (np.concatenate(docs), np.concatenate(prints)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _item_prints(window: int):
    def take(batches):
        for batch in batches:
            for c in chunks(batch.column("_text").cast(pa.binary()).to_pylist(), LETTERS, lower=True, most=SMALL_CHUNK):
                n = np.diff(c.at)
                doc, h = _prints(c, window, [])
                short = np.flatnonzero((n > 0) & (n < window))
                h = np.concatenate([h, Sums(c.ids).of(c.at[short], c.at[short + 1])])
                length = np.concatenate([np.zeros(len(doc), np.int64), n[short]])
                rows = pa.array(np.concatenate([doc, short]) + c.first)
                yield pa.RecordBatch.from_arrays([batch.column("_item").take(rows), pa.array(h.view(np.int64)), pa.array(length)], names=["_item", "_print", "_short"])

    return take


def _document_prints(fields: list[str], window: int, short: list[int], marks):
    """The ``fields``, _n (words) and _prints (different fingerprints that the bit table lets through), a row for each row."""

    def take(batches):
        for batch in batches:
            n, sizes, values = [], [], []
            for c in chunks(batch.column("_text").cast(pa.binary()).to_pylist(), LETTERS, lower=True, most=SMALL_CHUNK):
                n.append(np.diff(c.at))
                doc, h = _prints(c, window, short)
                bit = h & np.uint64(MARKS - 1)
                on = np.flatnonzero(marks.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                pairs = np.unique(np.stack([doc[on], h[on].view(np.int64)], 1), axis=0) if len(on) else np.zeros((0, 2), np.int64)
                sizes.append(np.bincount(pairs[:, 0], minlength=len(c.texts)))
                values.append(pairs[:, 1])
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), lists], names=[*fields, "_n", "_prints"])

    return take


def extend(doc: list[bytes], items: list[list[bytes]], window: int) -> tuple[int, list[int]]:
    """How many words of ``doc`` lie in occurrences of the items' windows, and which items occur, by the words themselves."""
    known: dict[bytes, int] = {}
    coded = [np.array([known.setdefault(w, len(known) + 1) for w in item], np.int64) for item in items]
    own = np.array([known.get(w, 0) for w in doc], np.int64)  # 0: in no item
    edge, found = np.zeros(len(own) + 1, np.int64), set()
    for n in sorted({min(window, len(c)) for c in coded}):
        these = [i for i, c in enumerate(coded) if min(window, len(c)) == n and len(c)]
        if len(own) < n or not these:
            continue
        name = window_names(np.concatenate([own, *(coded[i] for i in these)]), n)
        mine = name[: len(own) - n + 1]
        at, of_items = len(own), []
        for i in these:
            starts = len(coded[i]) - n + 1
            of_items.append(name[at : at + starts])
            at += len(coded[i])
        start = np.flatnonzero(np.isin(mine, np.concatenate(of_items)))
        edge[start] += 1
        edge[start + n] -= 1
        shared = np.unique(mine[start])
        found |= {i for i, names in zip(these, of_items, strict=True) if np.isin(names, shared).any()}
    return int(np.count_nonzero(np.cumsum(edge)[:-1])), sorted(found)


def _extend(window: int):
    def mark(batches):
        for batch in batches:
            rows = zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_texts").to_pylist(), strict=True)
            hits, names = [], []
            for text, items in rows:
                hit, found = extend(words(text), [words(x["_text"].encode()) for x in items], window)
                hits.append(hit)
                names.append(sorted({name for i in found for name in items[i]["_names"]}))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(hits, pa.int64()), pa.array(names, pa.list_(pa.string()))], names=["_id", "_key", "_hit", "_names"])

    return mark


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_key"] == b["_key"])


def _searched(docs: DataFrame, items: DataFrame, fields: list[str], text: str, id: str, item_id: str, item_text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _key, the fields as _f0 ..., _n) for each row, and (_id, _key, _hit, _names) for rows that share a fingerprint, once each."""
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).cast("string").alias("_name"), F.col(item_text).alias("_text")).where("_text is not null")
    wanted = checkpointed(wanted.groupBy("_text").agg(F.collect_set("_name").alias("_names")).withColumn("_item", F.unhex(F.sha2("_text", 256))))
    prints = checkpointed(wanted.select("_item", "_text").mapInArrow(_item_prints(window), "_item binary, _print long, _short long").distinct())
    short = [r[0] for r in prints.where("_short > 0").select("_short").distinct().collect()]  # fewer than ``window`` lengths
    bit = F.col("_print").bitwiseAND(MARKS - 1)
    table = np.zeros(MARKS // 64, np.int64)
    for at, bits in prints.select(F.shiftright(bit, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("b")).groupBy("at").agg(F.bit_or("b")).collect():  # MARKS / 64 rows at most
        table[at] = bits
    marks = spark.sparkContext.broadcast(table.view(np.uint64))

    base = docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), *(F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)), F.col(text).alias("_text"))
    carried = ["_id", "_key", *(f"_f{i}" for i in range(len(fields)))]
    schema = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in carried)
    rows = checkpointed(base.mapInArrow(_document_prints(carried, window, short, marks), f"{schema}, _n long, _prints array<long>"))
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST else df
    sharing = rows.where(F.size("_prints") > 0).select("_id", "_key", F.explode("_prints").alias("_print"))
    pairs = checkpointed(sharing.join(few(prints.select("_item", "_print")), "_print").select("_id", "_key", "_item").distinct())
    texts = pairs.join(few(wanted), "_item").groupBy("_id", "_key").agg(F.collect_list(F.struct("_text", "_names")).alias("_texts"))
    hot = few(pairs.select(F.col("_id").alias("_i"), F.col("_key").alias("_k")).distinct())  # first, so that only texts which share a fingerprint are shuffled
    near = base.select("_id", "_key", "_text").join(hot, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left_semi").dropDuplicates(["_id", "_key"])
    kind = base.schema["_id"].dataType.simpleString()
    found = near.join(texts, _same(near, texts)).select(near["_id"], near["_key"], near["_text"], "_texts").mapInArrow(_extend(window), f"_id {kind}, _key long, _hit long, _names array<string>")
    return rows.drop("_prints"), checkpointed(found.where("_hit > 0"))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """The ``keep`` columns, n_words, n_hit, n_items, items, items_sha256 and contaminated (n_hit > 0 and 20 * n_hit >= n_words), a row for each row."""
    rows, found = _searched(docs, items, list(keep), text, id, item_id, item_text, window)
    both = rows.join(found, _same(rows, found), "left")
    hit, names = F.coalesce("_hit", F.lit(0)).cast("long"), F.coalesce("_names", F.array().cast("array<string>"))
    return both.select(
        *(F.col(f"_f{i}").alias(f) for i, f in enumerate(keep)),
        F.col("_n").alias("n_words"),
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        names.alias("items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        _contaminated(hit).alias("contaminated"),
    )


def _contaminated(hit: Column) -> Column:
    return (hit > 0) & (20 * hit >= F.col("_n"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """``docs``, all columns, whatever their names, without the rows that are contaminated."""
    return on_plain_names(docs, lambda d, t, i: _decontaminated(d, items, t, i, item_id, item_text, window), text, id)


def _decontaminated(docs: DataFrame, items: DataFrame, text: str, id: str, item_id: str, item_text: str, window: int) -> DataFrame:
    rows, found = _searched(docs, items, [], text, id, item_id, item_text, window)
    bad = checkpointed(rows.join(found, _same(rows, found)).where(_contaminated(F.col("_hit"))).select(rows["_id"].alias("__id"), rows["_key"].alias("__key")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST else bad
    return docs.join(bad, F.col(id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__key")), "left_anti")
