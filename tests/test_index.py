"""The index of candidates: it loses no pair that covers, and leaves few others to test."""

import random

import pytest
from pyspark.sql import functions as F

from linepatterns.operators import aggregate

SCHEMA = "constants array<string>, n_constants int, gap_min array<int>, gap_max array<int>, own_support long, support long, first_line_id long"


def covers(p, q):
    (c, _, lo, hi), (words, _, low, high) = p[:4], q[:4]
    path = [(None, 0, 0)]
    for w, a, b in zip([*words, None], low, high, strict=True):
        path += [(None, a, b)] * (b > 0) + [(w, 1, 1)] * (w is not None)
    at = a = b = 0
    for w, x, y in path[1:]:
        a, b = a + x, b + y
        if at == len(c) or a - 1 < lo[at]:
            continue
        if b - 1 > hi[at]:
            return False
        if w == c[at]:
            at, a, b = at + 1, 0, 0
    return at == len(c) and lo[at] <= a and b <= hi[at]


def some(n, seed, words, longest, wide):
    rng, out = random.Random(seed), {}
    while len(out) < n:
        c = tuple(rng.choice(words) for _ in range(rng.randint(1, longest)))
        lo = [rng.choice([0, 0, 0, 1, 2]) for _ in range(len(c) + 1)]
        out[c] = (list(c), len(c), lo, [x + rng.choice([0, 0, 1, rng.randint(0, wide)]) for x in lo], rng.randint(1, 9), 0, len(out))
    return list(out.values())


@pytest.mark.parametrize(("spread", "near"), [(16, 4), (0, 1), (2, 2)])
def test_no_pair_is_lost(spark, monkeypatch, spread, near):
    monkeypatch.setattr(aggregate, "SPREAD", spread)
    monkeypatch.setattr(aggregate, "NEAR", near)
    rows = some(250, 1, "abc", 6, 3) + some(60, 2, "xyz", 5, 40) + [(["k"] * 40, 40, [0] * 41, [0] * 41, 5, 0, 999), (["k"], 1, [0, 0], [100, 100], 5, 0, 998)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {tuple(p[0]): p[4] + sum(q[4] for q in rows if q[1] > p[1] and any(p[3]) and covers(p, q)) for p in rows}
    got = {tuple(r["constants"]): r["support"] for r in aggregate.aggregate_supports(df).collect()}
    assert got == want and sum(want.values()) > sum(r[4] for r in rows)
    assert aggregate.aggregate_supports(df.where("false")).collect() == []


def test_few_pairs_are_tested(spark):
    """Candidates of one vocabulary: lines of eight words, any of four masked. All hold the same four words, so no word alone tells them apart."""
    rng, out = random.Random(3), {}
    while len(out) < 20_000:
        line = ["evt", rng.choice("pqrs"), "user", f"u{rng.randint(0, 300)}", "amount", rng.choice(["high", "low"]), "key", f"v{rng.randint(0, 60)}"]
        masked = set(rng.sample([1, 3, 5, 7], rng.randint(0, 3)))
        c, gaps, run = [], [], 0
        for i, w in enumerate(line):
            if i in masked:
                run += 1
            else:
                c.append(w)
                gaps.append(run)
                run = 0
        out[tuple(c)] = (c, len(c), [*gaps, run], [*gaps, run], 1, 0, len(out))
    rows = aggregate.indexed(spark.createDataFrame(list(out.values()), SCHEMA).repartition(8))
    tested, matched = aggregate.possible_pairs(rows).distinct().count(), aggregate.covered(rows).count()
    print(f"{tested} pairs tested, {matched} matched")
    assert matched > 10_000 and tested <= 2 * matched


def test_exact_places(spark):
    """Without a leading gap both begin alike; with an exact place a word must stand there."""
    make = lambda c, lo, hi, n=0: (c.split(), len(c.split()), lo, hi, 1, 1, n)
    rows = [make("a c", [0, 1, 0], [0, 1, 0]), make("a b c", [0] * 4, [0] * 4, 1), make("a b d", [0] * 4, [0] * 4, 2), make("b a c", [0] * 4, [0] * 4, 3), make("a x x c", [0] * 5, [0] * 5, 4)]
    df = aggregate.indexed(spark.createDataFrame(rows, SCHEMA))
    place = {r["id"]: " ".join(r["constants"]) for r in df.collect()}
    assert {(place[r[0]], place[r[1]]) for r in aggregate.possible_pairs(df).collect()} == {("a c", "a b c")}
    assert df.where(F.col("lead").isNull()).count() == 0
