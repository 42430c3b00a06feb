"""Exact removal of repeated passages by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one row. Each word covered by a window whose words also start anywhere else
(in another row, a repeated row or the same row) is removed; windows are judged on the input.

Sparse suffixes. Suffixes are filed from an *anchor* on: the place in a window whose ``PREFIX``-word run has the smallest hash,
the leftmost of equals. Equal windows have equal anchors, and consecutive windows mostly share theirs, so a run of them travels
as one row: its *context*, the words it spans. Anchors' runs of words that occur once in the corpus hold no repeat and go at once.
Hashes only decide what may meet. A context is told from others by a 128-bit BLAKE2 digest of its words, and what repeats
is decided on words.

Prefix partition. Equal contexts are counted by partial aggregation, so a passage in a third of all rows never meets in one
task. The different contexts of a prefix of ``PREFIX`` words are put together, whole prefixes at a time, in groups of at most
2 * ``GROUP``. A prefix with more than ``GROUP`` is lengthened: its suffixes, now one for each window, are dealt out by their first
``LENGTHS`` words, one length after the other, until each part fits. A prefix as long as the window is itself a node of that depth.

Subtrees. In each group the suffixes are ranked by their first 1, 2, 4 ... words up to the window, which is the sorted order of
the leaves of its suffix tree; neighbours of equal rank have a common prefix of a window or more. So leaves of equal rank are
those below one internal node of that depth, and all with company (or with a context that occurs more than once) are repeats.

Tables of bits, set by the rows that have a share in something, keep other texts out of the shuffles; they never change results.

Nulls and empty texts have no words; fewer words than a window are kept. Rows with an equal id and text are different places,
so they repeat one another. Only ``keep`` and the text are read of the columns of ``docs``, whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepatterns.llm._words import SPACED, Sums, bit_table, canonical, checkpointed, chunks, labelled, sliding_min, window_names

PREFIX = 8
GROUP = 4_000
LENGTHS = (12, 18, 26)
_PLACE = np.uint64(32)


def _chunks(batch):
    return chunks([canonical(t) for t in batch.column("_text").cast(pa.binary()).to_pylist()], SPACED)


def _runs(c, window: int):
    """Runs of windows that share an anchor, in a chunk: document, first start, last start, hash of the anchor's words."""
    n = len(c.ids)
    if n < window:
        return None
    at = np.arange(n - PREFIX + 1)
    prefix = Sums(c.ids).of(at, at + PREFIX)
    place = sliding_min((prefix >> _PLACE << _PLACE) | at.astype(np.uint64), window - PREFIX + 1) & np.uint64(0xFFFFFFFF)
    doc = np.repeat(np.arange(len(c.texts)), np.diff(c.at))
    start = np.flatnonzero(c.at[doc + 1][: n - window + 1] - np.arange(n - window + 1) >= window)
    if not len(start):
        return None
    place = place[start].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(start) != 1)]))
    first, last = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
    return doc[first], first, last, prefix[place[new]]


def _find_prefixes(window: int):
    def find(batches):
        for batch in batches:
            for c in _chunks(batch):
                if (found := _runs(c, window)) is not None:
                    prefix, n = np.unique(found[3], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(n)], names=["_prefix", "_n"])

    return find


def _find_runs(window: int):
    def find(batches):
        for batch in batches:
            for c in _chunks(batch):
                if (found := _runs(c, window)) is None:
                    continue
                doc, first, last, prefix = found
                text = c.buf.tobytes()
                context = [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(c.starts[first].tolist(), c.ends[last + window - 1].tolist(), strict=True)]
                rows = pa.array(doc + c.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(rows), batch.column("_key").take(rows), pa.array((first - c.at[doc]) << 16 | (last - first)), pa.array(prefix.view(np.int64)), pa.array(context, pa.binary())],
                    names=["_id", "_key", "_run", "_prefix", "_context"],
                )

    return find


def _context_words(window: int):
    """The words that each listed run of a text spans."""

    def words(batches):
        for batch in batches:
            runs = batch.column("_runs").to_pylist()
            for c in _chunks(batch):
                text, out = c.buf.tobytes(), []
                for d in range(len(c.texts)):
                    for r in runs[c.first + d]:
                        lo = c.at[d] + (r["_run"] >> 16)
                        out.append((r["_context"], r["_n"], r["_prefix"], text[c.starts[lo] : c.ends[lo + (r["_run"] & 0xFFFF) + window - 1]]))
                for i in range(0, len(out), 5000):
                    x, n, p, w = zip(*out[i : i + 5000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(n, pa.int64()), pa.array(p, pa.int64()), pa.array(w, pa.binary()).cast(pa.string())], names=["_context", "_n", "_prefix", "_words"])

    return words


def deep_leaves(texts: list[list[bytes]], many: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of the suffixes below nodes of depth ``window`` with two leaves or more; ``many``: texts that count as two."""
    known: dict[bytes, int] = {}
    size = np.array([len(t) for t in texts])
    words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, size.sum())
    begin = np.cumsum(size) - size
    suffixes = size - window + 1
    owner = np.repeat(np.arange(len(size)), suffixes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
    node = window_names(words, window)[begin[owner] + offset]
    leaves = np.bincount(node, 1 + many[owner])
    hit = np.flatnonzero(leaves[node] > 1)
    return owner[hit], offset[hit]


def _subtree(window: int):
    def build(table: pa.Table) -> pa.Table:
        texts = [t.split(b" ") for t in table.column("_words").cast(pa.binary()).to_pylist()]
        owner, offset = deep_leaves(texts, np.array(table.column("_n").to_pylist()) > 1, window)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(offset) != 1)])) if len(owner) else np.zeros(0, np.int64)
        end = np.concatenate([new[1:], [len(owner)]])[: len(new)] - 1
        rows = pa.array(owner[new])
        at = np.array(table.column("_at").to_pylist(), np.int64)[owner[new]]
        return pa.table({"_context": table.column("_context").take(rows), "_n": table.column("_n").take(rows), "_lo": pa.array(at + offset[new]), "_hi": pa.array(at + offset[end])})

    return build


def _suffixes(window: int):
    """A row for each window of a context: its offset and words."""

    def take(batches):
        for batch in batches:
            x, n, at, words = [], [], [], []
            for context, count, text in zip(batch.column("_context").to_pylist(), batch.column("_n").to_pylist(), batch.column("_words").to_pylist(), strict=True):
                w = text.split(" ")
                for i in range(len(w) - window + 1):
                    x.append(context)
                    n.append(count)
                    at.append(i)
                    words.append(" ".join(w[i : i + window]))
            for i in range(0, len(x), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 5000], pa.binary()), pa.array(n[i : i + 5000], pa.int64()), pa.array(at[i : i + 5000], pa.int64()), pa.array(words[i : i + 5000], pa.string())], names=["_context", "_n", "_at", "_words"])

    return take


def _packed(sizes: DataFrame, key: str) -> DataFrame:
    """sizes (key, _size <= GROUP) -> (key, _size, _bin, _part): whole keys side by side, at most 2 * GROUP rows to each (_bin, _part)."""
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    bins = 1 + total // (64 * GROUP)
    upto = F.sum("_size").over(Window.partitionBy("_bin").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("_bin", F.pmod(F.xxhash64(key), F.lit(bins))).withColumn("_part", F.floor((upto - F.col("_size")) / GROUP))


_COVER = "_context binary, _n long, _lo long, _hi long"


def _covered(words: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """(_context, _n, _lo, _hi): ranges of windows of each context that repeat. words: _context, _n, _prefix, _words; sizes: _prefix, _size."""
    tree = lambda df: df.groupBy("_bin", "_part").applyInArrow(_subtree(window), _COVER)
    fit = words.join(_packed(sizes.where(F.col("_size") <= GROUP), "_prefix").drop("_size"), "_prefix")
    out = tree(fit.withColumn("_at", F.lit(0).cast("long")).select("_bin", "_part", "_context", "_n", "_at", "_words"))
    large = sizes.where(F.col("_size") > GROUP).select("_prefix")
    if large.isEmpty():
        return out
    left = checkpointed(words.join(large, "_prefix", "left_semi").mapInArrow(_suffixes(window), "_context binary, _n long, _at long, _words string"))
    for length in LENGTHS:
        left = left.withColumn("_lead", F.substring_index("_words", " ", length))
        parts = checkpointed(left.groupBy("_lead").agg(F.count("*").alias("_size"), F.sum("_n").alias("_all")).where("_all > 1"))
        fit = left.join(_packed(parts.where(F.col("_size") <= GROUP).drop("_all"), "_lead").drop("_size"), "_lead")
        out = out.unionByName(checkpointed(tree(fit.select("_bin", "_part", "_context", "_n", "_at", "_words"))))
        larger = parts.where(F.col("_size") > GROUP).select("_lead")
        larger = F.broadcast(larger) if larger.count() <= GROUP else larger
        left = checkpointed(left.join(larger, "_lead", "left_semi").drop("_lead"))
        if left.isEmpty():
            return out
    nodes = checkpointed(left.groupBy("_words").agg(F.sum("_n").alias("_leaves"), F.count("*").alias("n")).where("_leaves > 1").drop("_leaves").withColumn("_hit", F.lit(True)))
    return out.unionByName(labelled(left, nodes, "_words", left.count()).select("_context", "_n", F.col("_at").alias("_lo"), F.col("_at").alias("_hi")))


def _keep(fields: list[str]):
    def keep(batches):
        for batch in batches:
            spans = batch.column("_spans")
            until = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(spans), 0)))
            lo, hi = (np.asarray(spans.flatten().field(f)) for f in ("_lo", "_hi"))
            n_words, n_removed, kept, at = [], [], [], 0
            for text, end in zip(batch.column("_text").cast(pa.binary()).to_pylist(), until.tolist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if end > at:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, lo[at:end], 1)
                    np.add.at(edge, hi[at:end], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                    at = end
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [batch.column(f) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*fields, "n_words", "n_removed", "kept_text"])

    return keep


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", window: int = 35, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, the ``keep`` columns, n_words, n_removed and kept_text (the words left, joined by one space), a row for each row."""
    base = docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_key"] == b["_key"])
    row = F.xxhash64("_id", "_key")

    prefixes = base.select("_text").mapInArrow(_find_prefixes(window), "_prefix long, _n long")
    twice = checkpointed(prefixes.groupBy("_prefix").agg(F.sum("_n").alias("n")).where("n > 1").withColumn("_twice", F.lit(True)))
    n_runs = twice.agg(F.sum("n")).first()[0] or 0
    runs = base.mapInArrow(_find_runs(window), f"_id {kind}, _key long, _run long, _prefix long, _context binary")
    runs = checkpointed(labelled(runs, twice, "_prefix", n_runs).drop("_twice"))

    contexts = checkpointed(runs.groupBy("_context").agg(F.count("*").alias("_n"), F.first("_prefix").alias("_prefix"), F.min(F.struct("_id", "_key", "_run")).alias("_one")))
    sizes = checkpointed(contexts.groupBy("_prefix").agg(F.count("*").alias("_size")).where("_size > 1"))
    members = labelled(contexts, sizes.withColumn("n", F.col("_size")), "_prefix", contexts.count())
    one = checkpointed(members.groupBy("_one._id", "_one._key").agg(F.collect_list(F.struct("_context", "_n", "_prefix", F.col("_one._run").alias("_run"))).alias("_runs")))
    near = base.where(bit_table(one, row)(row))
    words = checkpointed(near.dropDuplicates(["_id", "_key"]).join(one, same(near, one)).select(near["_text"], "_runs").mapInArrow(_context_words(window), "_context binary, _n long, _prefix long, _words string"))

    whole = contexts.where("_n > 1").select("_context", "_n", F.lit(0).cast("long").alias("_lo"), F.lit(None).cast("long").alias("_hi"))
    part = _covered(words, sizes, window).where("_n = 1")
    cover = whole.unionByName(part).groupBy("_context").agg(F.max("_n").alias("n"), F.collect_set(F.struct("_lo", "_hi")).alias("_ranges"))  # no more than a context has windows
    found = labelled(runs.select("_id", "_key", "_run", "_context"), checkpointed(cover), "_context", n_runs).select("_id", "_key", "_run", F.explode("_ranges").alias("_r"))
    first = F.shiftright("_run", 16)
    found = found.select("_id", "_key", (first + F.col("_r._lo")).alias("_lo"), (first + F.coalesce("_r._hi", F.col("_run").bitwiseAND(0xFFFF)) + window).alias("_hi"))
    spans = checkpointed(found.groupBy("_id", "_key").agg(F.collect_set(F.struct("_lo", "_hi")).alias("_spans")))

    fields = [f"_f{i}" for i in range(1 + len(keep))]
    kept = docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text"), *(F.col(k).alias(f) for k, f in zip((id, *keep), fields, strict=True)))
    touched = bit_table(spans, row)
    some = kept.where(touched(row))
    some = some.join(spans, same(some, spans), "left").select(*(some[f] for f in fields), some["_text"], "_spans")
    none = kept.where(~touched(row)).select(*fields, "_text", F.lit(None).cast(spans.schema["_spans"].dataType).alias("_spans"))
    schema = ", ".join(f"{f} {kept.schema[f].dataType.simpleString()}" for f in fields)
    out = some.unionByName(none).mapInArrow(_keep(fields), f"{schema}, n_words long, n_removed long, kept_text string")
    return out.select(*(F.col(f).alias(k) for k, f in zip((id, *keep), fields, strict=True)), "n_words", "n_removed", "kept_text")
