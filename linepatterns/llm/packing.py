"""Documents packed into sequences of a fixed number of tokens: bin completion over the counts of lengths.

Documents are encoded whole and ``end`` is added; one longer than ``capacity`` is cut into pieces of ``capacity`` tokens, of which the first may be
shorter. What has to be packed is then a table of at most ``capacity`` counts, one for each length, however many documents there are. That
table alone reaches the driver, which plans; Spark numbers the pieces of each length and gives each its place by the plan.

Plan (``complete``). A node of the search is what is left of the counts. The largest length left opens sequences; its fillings are enumerated
by the room they waste, larger pieces first, without those that are dominated: some pieces of a filling could be replaced by one other
piece that is at least as long and still fits. A filling is applied to as many sequences as the counts allow, or to one, and the search goes on
with the rest. Branches are left when the sequences so far plus a lower bound for the rest (its tokens, and the pieces over half the capacity with what
can't stand beside them) reach the best solution known, which also bounds the waste a filling may have. The first solution is that of best fit, decreasing, done on
counts too. The search ends at the lower bound, or when all is searched: then no plan needs fewer sequences. ``nodes`` and ``width`` bound the
nodes and the fillings of a node; they bound the time of the search, not what it packs.

Pieces. Ids are those of the tokenizers library. If its file describes a plain byte-level scheme whose ids have the order of its merges, they are made by tiktoken
with the file's own vocabulary, which takes a third of the time; any other file goes through the library itself. Long texts are cut, for tiktoken, at spaces between two
characters that aren't white space, where these tokenizers always cut. Numbers within a length come from the order of the pieces in
the written table: a place in its partition, plus the counts of the partitions before, so a length that a third of all pieces have is
no group of one task.

Null texts are empty: a document of one token, ``end``. Null ids and repeated rows are documents of their own. An empty table gives no rows. Extra columns
are left out, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepatterns.llm._words import checkpointed

CHUNK = 1 << 20
#: fixed value: how byte-level tokenizers of this kind cut a text, one of two notations of the same rule
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between two characters that no notion of white space covers; the second one follows a single space.
_CUT = re.compile("(?<=[^\\s᠎​﻿])(?= [^\\s᠎​﻿])")


# ---------------------------------------------------------------- plan

Filling = dict[int, int]


def lower_bound(counts: Filling, capacity: int) -> int:
    """Sequences that any packing needs: pieces over half the capacity stand alone, and what can't stand beside them needs room elsewhere; the best such bound over all thresholds, that of the tokens among them."""
    lengths = np.array(sorted(counts), np.int64)
    if not len(lengths):
        return 0
    n = np.array([counts[x] for x in lengths.tolist()], np.int64)
    number, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    least = np.concatenate([[0], lengths[lengths * 2 <= capacity]])
    small = np.searchsorted(lengths, least, "left")
    half = np.searchsorted(lengths, capacity // 2, "right")
    alone = np.searchsorted(lengths, capacity - least, "right")
    middle = number[alone] - number[half]
    room = middle * capacity - (tokens[alone] - tokens[half])
    return int((number[-1] - number[alone] + middle + np.maximum(0, -(-(tokens[half] - tokens[small] - room) // capacity))).max())


def best_fit(counts: Filling, capacity: int) -> list[tuple[Filling, int]]:
    """(filling, sequences that have it): best fit, decreasing, on groups of equal sequences."""
    groups: dict[int, list[tuple[Filling, int]]] = {}  # by room left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        fresh: dict[int, list[tuple[Filling, int]]] = {}
        put = lambda filling, k, n, room: fresh.setdefault(room - k * length, []).append((filling | {length: k} if k else filling, n))
        for room in sorted(groups):
            for filling, n in groups[room]:
                k = room // length
                full = min(n, left // k) if k else 0
                some = min(left - full * k, k) if full < n and k else 0
                if full:
                    put(filling, k, full, room)
                if some:
                    put(filling, some, 1, room)
                if n - full - bool(some):
                    put(filling, 0, n - full - bool(some), room)
                left -= full * k + some
        k = capacity // length
        if left >= k:
            put({}, k, left // k, capacity)
        if left % k:
            put({}, left % k, 1, capacity)
        groups = fresh
    return [x for group in groups.values() for x in group]


class _Rest:
    """What is left to pack, and the sums that lengths from each place on can reach."""

    def __init__(self, counts: Filling, room: int):
        self.counts, self.lengths, mask = counts, sorted((x for x, n in counts.items() if n and x <= room), reverse=True), (1 << room + 1) - 1
        self.sums = [1]
        for length in reversed(self.lengths):
            bits, k, step = self.sums[-1], min(counts[length], room // length), 1
            while k:
                step = min(step, k)
                bits |= bits << step * length & mask
                k -= step
                step *= 2
            self.sums.append(bits)
        self.sums.reverse()

    def fillings(self, total: int, at: int = 0) -> Iterator[Filling]:
        """All fillings of exactly ``total`` tokens with the lengths from ``at`` on, those with the largest pieces first."""
        if not total:
            yield {}
            return
        while at < len(self.lengths) and self.sums[at] >> total & 1:
            length = self.lengths[at]
            for k in range(min(self.counts[length], total // length), 0, -1):
                if self.sums[at + 1] >> (total - k * length) & 1:
                    for rest in self.fillings(total - k * length, at + 1):
                        yield {length: k} | rest
            at += 1

    def dominated(self, filling: Filling, waste: int) -> bool:
        """Whether some pieces of the filling could be replaced by one other that is as long as they, or longer by ``waste`` at most."""
        free = sum(1 << x for x in self.lengths if self.counts[x] > filling.get(x, 0))
        one, more = 0, 0  # sums of one piece, of several
        for length, n in filling.items():
            for _ in range(n):
                more |= (one | more) << length
                one |= 1 << length
        return any(more << d & free or (d and one << d & free) for d in range(waste + 1))


def complete(counts: Filling, capacity: int, nodes: int = 3000, width: int = 6, looked_at: int = 200) -> list[tuple[Filling, int]]:
    """(filling, sequences that have it) for the given number of pieces of each length, in as few sequences as the search finds."""
    counts = {x: n for x, n in counts.items() if n}
    total = sum(x * n for x, n in counts.items())
    best = best_fit(counts, capacity)
    fewest, least = sum(n for _, n in best), lower_bound(counts, capacity)

    def children(rest: Filling, used: int, wasted: int) -> Iterator[tuple[Filling, int, int]]:
        largest = max(rest)
        after = rest | {largest: rest[largest] - 1}
        room = capacity - largest
        inside, found = _Rest(after, room), 0
        for waste in range(min(room, (fewest - 1) * capacity - total - wasted) + 1):
            if inside.sums[0] >> (room - waste) & 1:
                for seen, filling in enumerate(inside.fillings(room - waste)):
                    if seen >= looked_at or found >= width:
                        break
                    if not inside.dominated(filling, waste):
                        found += 1
                        whole = filling | {largest: filling.get(largest, 0) + 1}
                        most = min(rest[x] // k for x, k in whole.items())
                        yield whole, most, waste
                        if most > 1:
                            yield whole, 1, waste
            if found >= width:
                return

    # depth-first, with the way to the current node and what is still to be tried at each node on it
    way: list[tuple[Filling, int]] = []
    state = [(counts, 0, 0)]
    todo = [children(*state[0])] if counts else []
    while todo and nodes > 0 and least < fewest:
        rest, used, wasted = state[-1]
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
            state.pop()
            if way:
                way.pop()
            continue
        filling, n, waste = step
        nodes -= 1
        after = {x: m for x in rest if (m := rest[x] - n * filling.get(x, 0))}
        if wasted + n * waste > (fewest - 1) * capacity - total or used + n + lower_bound(after, capacity) >= fewest:
            continue
        if not after:
            best, fewest = [*way, (filling, n)], used + n
            continue
        way.append((filling, n))
        state.append((after, used + n, wasted + n * waste))
        todo.append(children(*state[-1]))
    return best


# ---------------------------------------------------------------- pieces


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ranked(path: str):
    """tiktoken's encoding of the same file, if the file says what that library does: bytes merged by rank within matches of the pattern, nothing before or after. Else None."""
    import tiktoken

    spec = json.loads(Path(path).read_text())
    model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
    plain = not (spec["normalizer"] or spec["post_processor"] or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
    plain &= model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
    plain &= len(added) == 1 and " " not in added[0]["content"] and not any(added[0][k] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]] if plain else []
    made = [model["vocab"].get(a + b) for a, b in merges]
    if not plain or None in made or any(x >= y for x, y in pairwise(made)):  # ids are not in the order of the merges
        return None
    byte = {c: i for i, c in enumerate(map(chr, range(256))) if c.isprintable() and not c.isspace() and ord(c) != 173}  # a byte stands for itself if it can be shown, else for the next sign from 256 on
    byte |= {chr(256 + n): i for n, i in enumerate(i for i in range(256) if chr(i) not in byte)}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i != added[0]["id"]}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added[0]["content"], np.array([added[0]["id"]], "<u4").tobytes()


def _chunks(text: str) -> Iterator[str]:
    while len(text) > CHUNK and (cut := _CUT.search(text, CHUNK)):
        yield text[: cut.start()]
        text = text[cut.start() :]
    yield text


def encode(text: str, path: str) -> bytes:
    """Ids of a whole text as bytes, little-endian and four for each id, as the tokenizers library gives them without added special tokens."""
    as_bytes = lambda ids: np.array(ids, "<u4").tobytes()
    if (known := _ranked(path)) is None:
        return as_bytes(_library(path).encode(text, add_special_tokens=False).ids)
    ranked, special, its_id = known
    return its_id.join(b"".join(as_bytes(ranked.encode_ordinary(c)) for c in _chunks(part)) for part in text.split(special))


def _pieces(path: str, capacity: int, end: int, with_ids: bool) -> Callable:
    last = np.array([end], "<u4").tobytes()
    names = ["_id", "piece", "start", "length", "ids_crc32", "_part", "_nth", *["ids"] * with_ids]

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            texts, rows = batch.column("_text"), []
            for i in range(len(batch)):
                ids = encode(texts[i].as_py() or "", path) + last
                n = len(ids) // 4
                start = 0
                for piece in range(-(-n // capacity)):
                    length = (n - 1) % capacity + 1 if not piece else capacity
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((i, piece, start, length, crc32(own), part, seen[length], *[own] * with_ids))
                    seen[length] += 1
                    start += length
            if rows:
                doc, piece, *rest = zip(*rows, strict=True)
                columns = [batch.column("_id").take(pa.array(doc)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in rest[:5])]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in rest[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def _placed(shared) -> Callable:
    def place(batches):
        keys, first, each, base, offset = shared.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "_number"))
            at = np.searchsorted(keys, (length << 44) + number, "right") - 1
            j = number - first[at]
            places = [pa.array(base[at] + j // each[at]), pa.array(offset[at] + j % each[at] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "_number"), *places], names=[*(c for c in batch.schema.names if c != "_number"), "sequence_id", "offset"])

    return place


def rules(plan: list[tuple[Filling, int]]) -> tuple[np.ndarray, ...]:
    """The plan by length: (key, first, each, base, offset) with key = (length, first); the pieces of that length numbered from first on go ``each`` to a sequence, into those from base on, from offset on."""
    out, next_number, base = [], dict.fromkeys((x for f, _ in plan for x in f), 0), 0
    for filling, n in plan:
        offset = 0
        for length in sorted(filling, reverse=True):
            out.append(((length << 44) + next_number[length], next_number[length], filling[length], base, offset))
            next_number[length] += filling[length] * n
            offset += filling[length] * length
        base += n
    return tuple(np.array(c, np.int64) for c in (zip(*sorted(out), strict=True) if out else [[]] * 5))


def pack(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """``id``, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids: a row for each piece. path: of a byte-level tokenizer's file."""
    spark = docs.sparkSession
    base = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    own = f"_id {kind}, piece int, start long, length long, ids_crc32 long"
    more = ", ids array<int>" if with_ids else ""
    pieces = checkpointed(base.mapInArrow(_pieces(path, capacity, end, with_ids), f"{own}, _part long, _nth long{more}"))
    counted = checkpointed(pieces.groupBy("length", "_part").agg(F.count("*").alias("n")))
    plan = complete({r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # ``capacity`` rows at most
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task and length
    before = counted.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), F.coalesce(upto, F.lit(0)).alias("_before"))
    numbered = pieces.join(before, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    shared = spark.sparkContext.broadcast(rules(plan))
    numbered = numbered.select("_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("_before") + F.col("_nth")).alias("_number"))
    return numbered.mapInArrow(_placed(shared), f"{own}{more}, sequence_id long, offset long").withColumnRenamed("_id", id)


def sequences(packed: DataFrame, id: str = "doc_id") -> DataFrame:
    """(sequence_id, n_tokens, ids, members) from pieces with their ids: the training sequences; members tells which piece begins where, in order."""
    members = F.sort_array(F.collect_list(F.struct("offset", F.col(id), "piece", "length", "ids")))  # ``capacity`` tokens at most
    found = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), members.alias("m"))
    parts = F.transform("m", lambda x: F.struct(x["offset"].alias("offset"), x[id].alias(id), x["piece"].alias("piece"), x["length"].alias("length")))
    return found.select("sequence_id", "n_tokens", F.flatten(F.transform("m", lambda x: x["ids"])).alias("ids"), parts.alias("members"))
