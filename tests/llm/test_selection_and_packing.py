"""Target resampling, the filter audit and packing, each against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from linepatterns.llm import _words, filter_audit, packing, queries, target_resampling
from tests.llm.test_operators import SCHEMA, SF, awkward, docs, empty, odd, same  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- 11


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return [crc32(f.encode()) % 10_000 for f in [*words, *map(" ".join, zip(words, words[1:], strict=False))]], len(words)


def plain_resample(rows, targets):
    features = [plain_features(t) for _, t in rows]
    s, t = Counter(b for f, _ in features for b in f), Counter(b for x in targets for b in plain_features(x)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for (d, _), (f, n) in zip(rows, features, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((i for i, r in enumerate(out) if r[4] >= 20), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    rank = {i: k + 1 for k, i in enumerate(order[: len(order) * 25 // 100])}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(out)]


def test_resampling(spark, docs, odd, monkeypatch):  # noqa: F811
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    targets = [r["text"] for r in bench.collect()]
    same(target_resampling.resample(docs, bench), plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], targets))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = plain_resample(rows, targets)
    for piece, full in ((1 << 20, 1 << 20), (7, 5)):
        monkeypatch.setattr(target_resampling, "PIECE", piece)
        monkeypatch.setattr(target_resampling, "FULL", full)
        same(target_resampling.resample(odd, bench), want)
    same(target_resampling.resample(odd, empty(spark)), plain_resample(rows, []))
    assert target_resampling.resample(empty(spark), bench).collect() == []


def test_resampling_draws_what_is_like_the_target(spark):
    rng = random.Random(2)
    text = lambda words: " ".join(rng.choice(words) for _ in range(60))
    near, far = [f"n{i}" for i in range(50)], [f"f{i}" for i in range(50)]
    df = spark.createDataFrame([(i, text(far if i % 4 else near)) for i in range(400)], "doc_id long, text string").repartition(5)
    out = target_resampling.resample(df, spark.createDataFrame([(text(near),) for _ in range(30)], "text string"))
    drawn = [r for r in out.where("rank is not null").collect()]
    assert sorted(r["rank"] for r in drawn) == list(range(1, 101)) and sum(r["doc_id"] % 4 == 0 for r in drawn) > 75


def test_vectors_merge_as_a_tree(spark):
    texts = spark.range(500).select(F.concat(F.lit("Word "), F.col("id") % 7, F.lit(" é")).alias("text")).repartition(40)
    want = Counter(b for i in range(500) for b in plain_features(f"Word {i % 7} é")[0])
    got = target_resampling.bucket_counts(texts, "text", 10_000)
    assert {i: n for i, n in enumerate(got.tolist()) if n} == want and len(got) == 10_000


# ---------------------------------------------------------------- 12


def plain_audit(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    found = []
    for d, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        found.append((part or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out, total = [], Counter()
    for part in {p for p, *_ in found}:
        for order in permutations("ABCDE"):
            left = [x for x in found if x[0] == part]
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[part, f] += len(gone)
                fails = [x for x in found if x[0] == part and f in x[1]]
                out.append((part, "".join(order), k + 1, len(left), len(gone), len(fails) - len(gone), sum(x[1] == {f} for x in fails), sum(x[2] for x in gone), sum(x[3] for x in gone)))
    return [(*r, total[r[0], r[1][r[2] - 1]]) for r in out]


LABELS = "doc_id long, quality int, toxic int"


def test_audit(spark, docs, odd, monkeypatch):  # noqa: F811
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    same(filter_audit.audit(filter_audit.flagged(docs, labels)), plain_audit(rows(docs), labels.select("doc_id", "quality", "toxic").collect()))
    twice = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (3, 1, 0), (17, 1, 1), (9999, 1, 1)], LABELS)
    want = plain_audit(rows(odd), twice.collect())
    same(filter_audit.audit(filter_audit.flagged(odd, twice)), want)
    monkeypatch.setattr(_words, "HOT", 3)  # texts of which some have many copies are broadcast
    same(filter_audit.audit(filter_audit.flagged(odd, twice)), want)
    assert filter_audit.audit(filter_audit.flagged(empty(spark), twice)).collect() == []


def test_audit_counts_a_state_once(spark):
    """Three filters have six orders and seven states with an edge; each state is counted once, and nothing stays held."""
    held = spark.sparkContext._jsc.getPersistentRDDs
    before = set(held())
    states = [(str(i % 2), False, False, *(bool(i >> k & 1) for k in range(3))) for i in range(16)]
    df = spark.createDataFrame(states, "part string, good boolean, toxic boolean, X boolean, Y boolean, Z boolean")
    found = filter_audit.edges(df, "XYZ")
    assert found.groupBy("part", "state", "filter").count().where("count > 1").isEmpty()
    assert {r["state"] for r in found.collect()} == set(range(7)) and set(held()) == before
    rows = [r for r in filter_audit.audit(df, "XYZ").collect() if r["filter_order"] == "ZXY" and r["part"] == "1"]
    assert sorted((r["step"], r["kept"], r["removed"], r["redundant"], r["unique_fails"]) for r in rows) == [(1, 4, 4, 0, 0), (2, 0, 4, 4, 2), (3, 0, 0, 4, 0)]
    assert len({r["shapley"] for r in filter_audit.audit(df, "X").collect()}) == 2


def test_audit_is_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.execute(queries.oracle_sql()["op12_filter_audit"])
    columns = [c[0] for c in want.description]
    same(queries.op12_filter_audit(spark, SF).select(*columns), want.fetchall())


# ---------------------------------------------------------------- 13


def fewest_sequences(lengths, capacity):
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {room: k for k, room in enumerate(rooms) if room >= lengths[i]}.values():
            put(i + 1, [r - lengths[i] * (k == j) for j, r in enumerate(rooms)])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


def uses(plan, capacity):
    out = Counter()
    for filling, n in plan:
        assert n > 0 and sum(x * k for x, k in filling.items()) <= capacity
        out.update({x: k * n for x, k in filling.items()})
    return out


def test_plans_need_as_few_sequences_as_any():
    rng, better = random.Random(3), 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 50])
        lengths = [rng.randint(*rng.choice([(1, capacity), (capacity // 6 + 1, capacity // 2)])) for _ in range(rng.randint(0, 11))]
        counts = Counter(lengths)
        plan, fit = packing.complete(counts, capacity), packing.best_fit(counts, capacity)
        assert uses(plan, capacity) == uses(fit, capacity) == counts
        n, least = sum(k for _, k in plan), fewest_sequences(lengths, capacity)
        assert packing.lower_bound(counts, capacity) <= least == n
        better += sum(k for _, k in fit) > n
    assert better  # best fit alone does not do


def test_plans_of_many_pieces():
    rng = random.Random(4)
    for scale in (1, 10**6):
        for low, high in ((1, 1024), (180, 370), (400, 1024)):
            counts = {x: scale * n for x, n in Counter(rng.randint(low, high) for _ in range(5000)).items()}
            plan = packing.complete(counts, 1024, nodes=800)
            assert uses(plan, 1024) == counts and len(plan) < 5000
            assert sum(n for _, n in plan) <= 1.02 * packing.lower_bound(counts, 1024)


def test_dominated_fillings():
    rest = packing._Rest({5: 1, 3: 1, 2: 2, 1: 3}, 6)
    assert rest.dominated({3: 1, 2: 1}, 0) and rest.dominated({3: 1, 1: 2}, 0) and rest.dominated({2: 2}, 1) and rest.dominated({3: 1}, 2)
    assert not rest.dominated({5: 1, 1: 1}, 0) and not rest.dominated({5: 1}, 0)
    assert list(rest.fillings(6)) == [{5: 1, 1: 1}, {3: 1, 2: 1, 1: 1}, {3: 1, 1: 3}, {2: 2, 1: 2}]


def pieces_of(rows, capacity=1024):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(PATH), []
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first, start = (len(ids) - 1) % capacity + 1, 0
        for k in range(-(-len(ids) // capacity)):
            own = ids[start : start + (capacity if k else first)]
            out.append((d, k, start, len(own), crc32(b"".join(i.to_bytes(4, "little") for i in own))))
            start += len(own)
    return out


def test_ids_are_those_of_the_library(tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(PATH), random.Random(6)
    signs = "aZ 09\n\t\r\xa0\x85\x1c\u200b\u3000\u180e\ufeff'\u2019sd.,!\u00e9\u0301\u4e2d\U0001f600\u0663\u00b2\x00\u00ad<|>"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", " " * 300_000 + "x", "^" * 100_000, "it's we'LL I'd", "x" * 50_000]
    whole = lambda t: b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)
    assert packing._ranked(PATH) is not None
    for chunk in (1 << 20, 3):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        assert [t for t in texts if packing.encode(t, PATH) != whole(t)] == []
    other = public_tokenizers.path("word_bpe_49k.json")  # another scheme: the library itself
    assert packing._ranked(other) is None
    assert packing.encode("Some Words", other) == b"".join(i.to_bytes(4, "little") for i in Tokenizer.from_file(other).encode("Some Words", add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_packing(spark, docs, odd, chunk, monkeypatch):  # noqa: F811
    monkeypatch.setattr(packing, "CHUNK", chunk)
    extra = spark.createDataFrame([(500 + i, t) for i, t in enumerate(["a <|endoftext|> b<|endoftext|>c", " a  b \n c　d᠎ e\xa0 f", "''s  it's  'x 1 ''", "x" * 4000, "é " * 3000])], "doc_id long, text string")
    for df in (docs, odd.unionByName(extra, allowMissingColumns=True)):
        packed = packing.pack(df, PATH)
        same(packed.drop("sequence_id", "offset"), pieces_of([(r["doc_id"], r["text"]) for r in df.collect()]))
        whole = {}
        for r in packed.collect():
            whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for spans in whole.values():
            spans.sort()
            assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 1024
        counts = Counter(n for spans in whole.values() for _, n in spans)
        assert len(whole) == sum(n for _, n in packing.complete(counts, 1024)) <= packing.lower_bound(counts, 1024) + 1
    assert packing.pack(empty(spark), PATH).collect() == []


def test_sequences_hold_the_tokens(spark, docs):  # noqa: F811
    packed = packing.pack(docs.withColumn("offset", F.lit(1)).withColumn("sequence_id", F.lit("x")), PATH, capacity=128, end=7, with_ids=True)
    joined = {}
    for r in packing.sequences(packed).collect():
        assert r["n_tokens"] == len(r["ids"]) <= 128
        for m in r["members"]:
            joined.setdefault(m["doc_id"], {})[m["piece"]] = r["ids"][m["offset"] : m["offset"] + m["length"]]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    for r in docs.collect():
        assert [x for _, p in sorted(joined[r["doc_id"]].items()) for x in p] == [*library.encode(r["text"] or "", add_special_tokens=False).ids, 7]
