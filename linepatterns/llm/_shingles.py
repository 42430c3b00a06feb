"""Texts linked by the Jaccard similarity of their word shingles, exactly: the link rule of ``simhash_dedup`` for a given similarity.

A text is the set of the hashes of its shingles of ``width`` words (all its words, if there are fewer), letters A-Z lowered.
Texts with a similarity of ``similar`` per cent or more are linked. Shingles and sets are told apart by 64-bit hashes.

Candidates. Two sets that are alike share at least ``similar`` per cent of the larger, so under any one order of all shingles
they share one among the first n - ceil(n * similar / 100) + 1 of each. The order is by a table of ``SLOTS`` counts, rare
slots first, so what many texts share is seldom looked up. In a large corpus each slot counts many shingles, and a common one in a slot that is not full stands
among the first of its texts. So keys that turn out to be crowded go to the end of the order, ``CROWDED`` at most, and prefixes are taken
again. Both tables only set the order; they never change results.

Pairs. Where at most ``BUCKET`` sets share a key, they are all paired. Under a larger key each is paired with a pivot, the one that has the fewest
rarer shingles, which is the plainest of a group of copies. Sets of different components are then filed by what each and its pivot don't share
(``pairs_beside_pivots``), as sets that are alike differ from a pivot in much the same. A pair is made only
if enough can be shared: the shingles from the key on, and those before it that any other set has among its first. A set's own
shingles are rare and come first, so texts that have no more than a passage in common fail this.

Bounds. Each row carries a histogram of its set in ``BINS`` counts. The sum of the smaller counts of two histograms is the most
that the sets can share, so most pairs that are not alike go before any set is fetched; sets are compared for the rest.

Pairs that ``simhash_dedup`` has found by Golay keys are compared first. What is above is the exact way for the rest: pairs inside a component of those links are left out.

Equal sets are one node, and texts without words are all equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepatterns.llm._words import SMALL_CHUNK, SPACED, Sums, bit_table, canonical, checkpointed, chunks, mix
from linepatterns.llm.graph import components, stars
from linepatterns.sources.shared import freeing

BUCKET = 16
SLOTS = 1 << 20
CROWDED = 1 << 19
BINS = 256
#: rows taken at a time
SLICE = 100


def shingle_sets(batch, width: int):
    """(shingle, text, first, size, sig) for some texts at a time: distinct shingles by text, then where each text's are, how many, and their hash."""
    for row in range(0, len(batch), SLICE):
        for c in chunks([canonical(t) for t in batch.column("_text").slice(row, SLICE).cast(pa.binary()).to_pylist()], SPACED, lower=True, most=SMALL_CHUNK):
            n = np.diff(c.at)
            many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
            text = np.repeat(np.arange(len(n)), many)
            lo = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + c.at[:-1][text]
            shingle = Sums(c.ids).of(lo, lo + np.minimum(n, width)[text])
            order = np.lexsort((shingle, text))
            text, shingle = text[order], shingle[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
            text, shingle = text[new], shingle[new]
            size = np.bincount(text, minlength=len(n))
            first = np.cumsum(size) - size
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingle + np.uint64(0x9E3779B97F4A7C15)))])
            sig = np.where(size > 0, mix(sums[first + size] - sums[first] + size.astype(np.uint64)), np.uint64(0)).view(np.int64)
            yield shingle, text, first, size, sig


def signatures(docs: DataFrame, text: str, id: str, width: int, fingerprint) -> DataFrame:
    """_id, _key (a hash of the text), sig, fp (what ``fingerprint`` gives for the text), size and bins (the histogram, a byte each; 255 stands for that and more), a row for each row."""
    base = docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text"))

    def take(batches):
        for batch in batches:
            at = 0
            for shingle, of, _, size, sig in shingle_sets(batch, width):
                k = len(size)
                fp = np.fromiter((fingerprint(t, width) for t in batch.column("_text").slice(at, k).cast(pa.binary()).to_pylist()), np.uint64, k).view(np.int64)
                bins = np.bincount(of * BINS + (shingle & np.uint64(BINS - 1)).astype(np.int64), minlength=k * BINS).reshape(k, BINS)
                bins = [row.tobytes() for row in np.minimum(bins, 255).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(at, k), batch.column("_key").slice(at, k), pa.array(sig), pa.array(fp), pa.array(size), pa.array(bins, pa.binary())], names=["_id", "_key", "sig", "fp", "size", "bins"])
                at += k

    return base.mapInArrow(take, f"_id {base.schema['_id'].dataType.simpleString()}, _key long, sig long, fp long, size long, bins binary")


def _slot(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(44)).astype(np.int64)


def slot_counts(texts: DataFrame, width: int) -> np.ndarray:
    def take(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for shingle, *_ in shingle_sets(batch, width):
                np.add.at(counts, _slot(shingle), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    found = freeing(texts.mapInArrow(take, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))).toArrow()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def _excess(counts: np.ndarray) -> np.ndarray:
    """What a slot counts above nearly all others: the rest is what any slot has, in a large corpus more than many texts share."""
    return np.clip(counts - int(np.quantile(counts, 0.99)), 0, 1 << 30).astype(np.int32)


def _order(shingle: np.ndarray, rank, last) -> np.ndarray:
    """Where shingles stand in the order: by their slot, or at the end if they are in ``last``, the sorted shingles that go there and their places."""
    out, (known, place) = rank.value[_slot(shingle)], last.value
    if len(known):
        at = np.minimum(np.searchsorted(known, shingle), len(known) - 1)
        out = np.where(known[at] == shingle, SLOTS + place[at], out)
    return out


def prefixes(texts: DataFrame, width: int, similar: int, rank, last, keys_only: bool) -> DataFrame:
    """(key, sig, n, place): each set under the first of its shingles, and the place of each; or only key and sig."""

    def take(batches):
        for batch in batches:
            for shingle, text, first, size, sig in shingle_sets(batch, width):
                order = np.lexsort((shingle, _order(shingle, rank, last), text))
                place = np.arange(len(text)) - first[text]
                here = place <= (size + (-size * similar) // 100)[text]  # n - ceil(n * similar / 100)
                of = text[here]
                columns = [pa.array(shingle[order][here].view(np.int64)), pa.array(sig[of])]
                names = ["key", "sig"]
                if not keys_only:
                    columns += [pa.array(size[of]), pa.array(place[here])]
                    names += ["n", "place"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(take, "key long, sig long" + ("" if keys_only else ", n long, place long"))


def crowded(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of (key, sig), the keys of more than about ``BUCKET`` sigs, sorted, and their places by how often they stand there; of too many the most frequent. Sigs are counted as bits of one number, which copies don't raise."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("sig").bitwiseAND(63).cast("int"))
    sized = checkpointed(freeing(keys.groupBy("key").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")).where(F.bit_count("bits") >= BUCKET - 2).select("key", "n")))
    least = 0
    while sized.where(F.col("n") > least).count() > CROWDED:
        least = 2 * least + BUCKET
    found = sized.where(F.col("n") > least).toArrow()
    key, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    place = np.argsort(np.lexsort((key, n))).astype(np.int32)
    by_key = np.argsort(key)
    return key[by_key], place[by_key]


def _in_company(batches):
    """Of rows (key, sig, n, place) sorted by key and sig, one for each sig of the keys that have several. Only the last row is held, however many a key has."""
    names, held, met = ("key", "sig", "n", "place"), None, False
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in names]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        new = np.ones(len(rows[0]), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows = [x[new] for x in rows]
        if not len(rows[0]):
            continue
        company, beside = np.zeros(len(rows[0]), bool), rows[0][1:] == rows[0][:-1]
        company[0] = met
        company[1:] |= beside
        company[:-1] |= beside
        held, met = [x[-1:] for x in rows], bool(company[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][company[:-1]]) for x in rows], names=list(names))
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=list(names))


def sets_of(texts: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(sig, set) of the sigs in ``wanted``, once each; a table of bits tells most others before they are shuffled."""
    may_want = bit_table(wanted, F.col("sig"))

    def take(batches):
        for batch in batches:
            for shingle, _, first, size, sig in shingle_sets(batch, width):
                _, once = np.unique(sig, return_index=True)
                keep = once[size[once] > 0]
                sets = [shingle[a : a + b].tobytes() for a, b in zip(first[keep].tolist(), size[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(sets, pa.binary())], names=["sig", "set"])

    found = texts.mapInArrow(take, "sig long, set binary").where(may_want(F.col("sig"))).join(wanted, "sig", "left_semi")
    return found.groupBy("sig").agg(F.first("set").alias("set"))


def _sides(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    left, right = of.select(F.col("sig").alias("a"), F.col(value).alias("_a")), of.select(F.col("sig").alias("b"), F.col(value).alias("_b"))
    return pairs.join(left, "a").join(right, "b")


def may_be_alike(pairs: DataFrame, bins: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose histograms allow it."""

    def take(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("_a", "_b"))
            size = np.asarray(batch.column("_n"))
            shared = np.minimum(a, b).sum(1, dtype=np.int64)
            open_ended = ((a == 255) | (b == 255)).any(1)
            keep = pa.array(np.flatnonzero(open_ended | ((100 + similar) * shared >= similar * size)))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    both = _sides(pairs, bins.withColumn("v", F.struct("bins", "size")), "v")
    return both.select("a", "b", F.col("_a.bins").alias("_a"), F.col("_b.bins").alias("_b"), (F.col("_a.size") + F.col("_b.size")).alias("_n")).mapInArrow(take, "a long, b long")


def alike(pairs: DataFrame, texts: DataFrame, width: int, bins: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) that are alike."""
    near = checkpointed(may_be_alike(pairs, bins, similar))
    sets = checkpointed(sets_of(texts, width, checkpointed(near.select(F.explode(F.array("a", "b")).alias("sig")).distinct())))

    def compare(batches):
        for batch in _slices(batches):
            sides = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True))
            keep = [i for i, (x, y) in enumerate(sides) if (100 + similar) * len(np.intersect1d(x, y, assume_unique=True)) >= similar * (len(x) + len(y))]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return _sides(near, sets, "set").select("a", "b", "_a", "_b").mapInArrow(compare, "a long, b long")


def _slices(batches):
    """A few rows at a time: they carry two whole sets each."""
    for batch in batches:
        for lo in range(0, len(batch), 128):
            yield batch.slice(lo, 128)


def _lost(batches):
    """(pivot, token, lost): tokens of a pivot and how many of some sets beside it lack each."""
    for batch in _slices(batches):
        of: dict[int, list[np.ndarray]] = {}
        for pivot, own, its in zip(*(batch.column(c).to_pylist() for c in ("pivot", "own", "its")), strict=True):
            of.setdefault(pivot, []).append(np.setdiff1d(np.frombuffer(its, np.uint64), np.frombuffer(own, np.uint64), assume_unique=True))
        for pivot, tokens in of.items():
            token, n = np.unique(np.concatenate(tokens), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), pivot)), pa.array(token.view(np.int64)), pa.array(n)], names=["pivot", "token", "lost"])


def _beside(similar: int, counts):
    """(pivot, sig, root, token, n, d, place, small) of rows with both sets: what stands in one of them only, as far as it has to be filed.

    The order is by how many sets beside the pivot differ from it in a token: those that lack it, if the pivot has it, else about those that have it anywhere, if these are many.
    """

    def take(batches):
        names = ("pivot", "sig", "root")
        for batch in _slices(batches):
            tokens, sizes, places, smalls, of = [], [], [], [], []
            known, times = (batch.column(c).flatten().to_numpy() for c in ("tokens", "times"))
            ends = np.asarray(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0)).cumsum()
            for i, (own, its) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("own", "its")), strict=True)):
                own, its = np.frombuffer(own, np.uint64), np.frombuffer(its, np.uint64)
                here = slice(ends[i - 1] if i else 0, ends[i])
                more, less = np.setdiff1d(own, its, assume_unique=True), np.setdiff1d(its, own, assume_unique=True)
                token = np.concatenate([more, less])
                often = np.concatenate([counts.value[_slot(more)], times[here][np.searchsorted(known[here], less.view(np.int64))]])
                d = len(token)
                token = token[np.lexsort((token, often))][: len(own) * (100 - similar) // similar + 1]
                place = np.arange(len(token))
                tokens.append(token)
                sizes.append(np.array([[len(own)], [d]]).repeat(len(token), 1))
                places.append(place)
                smalls.append(place <= len(own) * (100 - similar) // (2 * similar))
                of.append(np.full(len(token), i))
            if tokens:
                at, size = pa.array(np.concatenate(of)), np.concatenate(sizes, 1)
                columns = [pa.array(np.concatenate(tokens).view(np.int64)), *map(pa.array, size), pa.array(np.concatenate(places)), pa.array(np.concatenate(smalls))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), *columns], names=[*names, "token", "n", "d", "place", "small"])

    return take


def pairs_beside_pivots(members: DataFrame, texts: DataFrame, width: int, similar: int, counts) -> DataFrame:
    """(a, b): sets of different components beside the same pivot that may be alike. members: (pivot, sig, root).

    Let A and B be what two sets a and b don't share with their pivot p, so that a and b differ in what A and B don't share. If a and b are alike, they differ in at most
    (100 - s) / (100 + s) of their sizes together, at most t = |a| (100 - s) / s. So A and B share at least (|A| + |B| - t) / 2. They share one token at least
    unless both are alike to p, which those of different components are not: without any, |A| + |B| is at most that part of |a| + |b|; if a isn't alike to p, |A| is more than that part of
    |a| + |p|, so |B| is less than that part of |b| - |p|, but it is |b| - |p| at least. Hence, under one order of all tokens, the smaller of A and B has a shared token among its first t / 2 + 1, the larger among
    its first t + 1. What copies of a text have in common with it is not filed at all, and their own changes are rare, come first, and are shared by few.
    A pair is made only if enough can be shared: filed tokens before this one that any other has, it, and the fewer of those after it.
    """
    wanted = checkpointed(members.select(F.explode(F.array("sig", "pivot")).alias("sig")).distinct())
    sets = checkpointed(sets_of(texts, width, wanted))
    both = checkpointed(members.join(sets.select("sig", F.col("set").alias("own")), "sig").join(sets.select(F.col("sig").alias("pivot"), F.col("set").alias("its")), "pivot"))
    lost = both.mapInArrow(_lost, "pivot long, token long, lost long").groupBy("pivot", "token").agg(F.sum("lost").alias("lost"))
    lost = lost.groupBy("pivot").agg(F.sort_array(F.collect_list(F.struct("token", "lost"))).alias("t")).select("pivot", F.col("t.token").alias("tokens"), F.col("t.lost").alias("times"))  # as many as the pivot has tokens
    schema = "pivot long, sig long, root long, token long, n long, d long, place long, small boolean"
    filed = checkpointed(both.join(lost, "pivot", "left").select("pivot", "sig", "root", "own", "its", "tokens", "times").mapInArrow(_beside(similar, counts), schema))
    shared = filed.groupBy("pivot", "token").agg(F.min("sig").alias("low"), F.max("sig").alias("high"), F.max("small").alias("any")).where("low <> high and any").select("pivot", "token")
    kept = filed.join(shared, ["pivot", "token"])
    kept = checkpointed(kept.withColumn("before", F.row_number().over(Window.partitionBy("pivot", "sig").orderBy("place")) - 1))
    side = lambda s: kept.select("pivot", "token", *(F.col(c).alias(f"{c}_{s}") for c in ("sig", "root", "n", "d", "place", "small", "before")))
    shares = F.least("before_a", "before_b") + 1 + F.least(F.col("d_a") - F.col("place_a"), F.col("d_b") - F.col("place_b")) - 1
    enough = 2 * (100 + similar) * shares >= (100 + similar) * (F.col("d_a") + F.col("d_b")) - (100 - similar) * (F.col("n_a") + F.col("n_b"))
    order = (F.col("d_a") < F.col("d_b")) | ((F.col("d_a") == F.col("d_b")) & (F.col("sig_a") < F.col("sig_b")))
    met = side("a").where("small_a").join(side("b"), ["pivot", "token"]).where(order & (F.col("root_a") != F.col("root_b")) & enough)
    return met.select(F.least("sig_a", "sig_b").alias("a"), F.greatest("sig_a", "sig_b").alias("b")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    a, b = (roots.select(F.col("node").alias(s), F.col("root").alias(f"_{s}")) for s in ("a", "b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def links(docs: DataFrame, bins: DataFrame, text: str, width: int, similar: int, first: DataFrame) -> DataFrame:
    """(node, root) of the sigs that are alike but not equal, checkpointed. bins: (sig, size, bins) of each sig, checkpointed; first: pairs (a, b) to compare before the others, which then have to join components of these only."""
    texts = docs.select(F.col(text).alias("_text"))
    known = checkpointed(components(alike(first, texts, width, bins, similar)))
    counts = slot_counts(texts, width)
    send = docs.sparkSession.sparkContext.broadcast
    rank = send(np.argsort(np.argsort(counts, kind="stable"), kind="stable").astype(np.int32))
    none = send((np.empty(0, np.uint64), np.empty(0, np.int32)))
    last = send(crowded(prefixes(texts, width, similar, rank, none, True)))
    entries = prefixes(texts, width, similar, rank, last, False).repartition("key").sortWithinPartitions("key", "sig")
    filed = entries.mapInArrow(_in_company, "key long, sig long, n long, place long")
    filed = checkpointed(freeing(filed.withColumn("before", F.row_number().over(Window.partitionBy("sig").orderBy("place")) - 1)))  # keys before this one that any other set has
    size = filed.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("place", "sig", "n", "before")).alias("least"))
    sized = checkpointed(freeing(filed.join(size, "key")))
    side = lambda df, s, *more: df.select("key", F.col("sig").alias(s), F.col("n").alias(f"n_{s}"), F.col("place").alias(f"place_{s}"), F.col("before").alias(f"before_{s}"), *more)
    rest = F.least("before_a", "before_b") + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))  # no more is shared than the shared keys before this one, and what is from it on
    may = (100 + similar) * rest >= similar * (F.col("n_a") + F.col("n_b"))
    few = sized.where(f"m <= {BUCKET}")
    near = side(few, "a").join(side(few, "b"), "key").where("a < b").where(may).select("a", "b")
    large = sized.where(f"m > {BUCKET}")
    plainest = [F.col(f"least.{c}").alias(f"{c}_a") for c in ("n", "place", "before")]
    own = [F.col(c).alias(f"{c}_b") for c in ("n", "place", "before")]
    beside = large.where(F.col("sig") != F.col("least.sig")).select(F.col("least.sig").alias("a"), F.col("sig").alias("b"), *plainest, *own)
    beside = beside.where(may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = checkpointed(components(stars(known).unionByName(alike(checkpointed(_apart(near.unionByName(beside).distinct(), known)), texts, width, bins, similar))))
    named = large.select("key", "sig", F.col("least.sig").alias("pivot")).join(roots, large["sig"] == roots["node"], "left").select("key", "sig", "pivot", F.coalesce("root", "sig").alias("root"))
    named = checkpointed(named)
    apart = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    members = checkpointed(named.join(apart, "key").where("sig <> pivot").select("pivot", "sig", "root").distinct())
    if members.isEmpty():
        return roots
    more = checkpointed(pairs_beside_pivots(members, texts, width, similar, send(_excess(counts))))
    if more.isEmpty():
        return roots
    found = checkpointed(alike(more, texts, width, bins, similar))
    return roots if found.isEmpty() else checkpointed(components(stars(roots).unionByName(found)))
