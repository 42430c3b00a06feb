"""Exact near duplicates against all pairs."""

import random
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linepatterns.llm import _shingles, decontaminate, graph, simhash_dedup
from linepatterns.llm._words import checkpointed
from linepatterns.sources.shared import FREE, freeing
from tests.llm.test_operators import awkward, pairs, same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute(docs, width=5, similar=80):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 100 * len(a & b) >= similar * len(a | b) > 0:
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    return [(d, first.get(find(i))) for i, (d, _) in enumerate(docs)]


def edited():
    """Groups of texts with up to 8 of 100 words changed, and texts that share half of their words with many."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, common = [], [word() for _ in range(50)]
    for _ in range(4):
        base = [word() for _ in range(100)]
        for _ in range(40):
            w = list(base)
            for at in rng.sample(range(100), rng.randint(0, 8)):
                w[at] = word()
            rows.append(" ".join(w))
    rows += [" ".join(common + [word() for _ in range(rng.randint(0, 60))]) for _ in range(60)]
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("bucket", [16, 1])
def test_against_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(_shingles, "BUCKET", bucket)
    rows = edited() + [(2000 + i, r[1]) for i, r in enumerate(awkward())] + [(None, "one two three four five six"), (None, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(simhash_dedup.near_duplicates(df, width=5, similar=80).select("doc_id", "component_id"), brute(rows))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(simhash_dedup.near_duplicates(docs, width=5, similar=80).select("doc_id", "component_id"), brute(pairs(docs)))


def test_stage_drops_edited_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {d for d, _ in pairs(corpus_pipeline.dedup(spark, docs, SF))}
    assert kept == {c for _, c in brute(pairs(docs))}
    assert not {145, 177} & kept  # 7 and 11 bits from 6 and 1


def test_golay_keys_find_links_first(spark, monkeypatch):
    """The stage compares texts whose fingerprints share a key before others, and what these link is not compared again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    end = docs.where("doc_id < 20").select((F.col("doc_id") + 5000).alias("doc_id"), F.concat("text", F.lit(" and this is its end")).alias("text"))
    rows = pairs(docs.union(end))
    seen = []
    alike = _shingles.alike

    def testing(pairs, *more):
        out = checkpointed(alike(pairs, *more))
        seen.append(({tuple(r) for r in pairs.select("a", "b").collect()}, {tuple(r) for r in out.collect()}))
        return out

    monkeypatch.setattr(_shingles, "alike", testing)
    same(simhash_dedup.one_of_each(docs.union(end)).select("doc_id"), [(d,) for d in {c for _, c in brute(rows)}])
    assert seen[0][1] and not any(seen[0][1] & tried for tried, _ in seen[1:])
    fps = {simhash_dedup.fingerprint(t.encode(), 5) for _, t in rows if t}
    filed = simhash_dedup.alike_by_keys(spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))], "sig long, fp long"))
    near = {(i, j) for i, f in enumerate(sorted(fps)) for j, g in enumerate(sorted(fps)) if i < j and (f ^ g).bit_count() <= 2}
    assert near <= {tuple(r) for r in filed.collect()}


def test_no_rows(spark):
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA), similar=80).collect() == []


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, null ids and ids that stand for several texts; extra columns with names that are used inside."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (2, text + " end"), (None, text), (None, "alone " * 9), (None, "alone " * 9), (1, "quite another text"), (3, None), (4, ""), (5, None)]
    df = spark.createDataFrame([(*r, i, i, i) for i, r in enumerate(rows)], SCHEMA + ", _key long, sig long, _id long").repartition(3)
    out = simhash_dedup.one_of_each(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, text), (None, "alone " * 9), (1, "quite another text"), (3, None)], key=repr)
    assert simhash_dedup.one_of_each(df.limit(0)).collect() == []


def test_copies_below_the_threshold_are_not_paired(spark, monkeypatch):
    """Texts of one origin that differ too much to be linked, a few alike among them, and others that share half of it: pairs follow the number of texts, not its square."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(200)], []
    for _ in range(400):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(5, 7)):
            w[at] = word()
        rows.append(" ".join(w))
    rows += [r.replace(r.split()[3], "zz") for r in rows[:30]] + [" ".join(base[:100] + [word() for _ in range(100)]) for _ in range(100)]
    rows = list(enumerate(rows))
    seen, tested = [], []
    beside, alike = _shingles.pairs_beside_pivots, _shingles.alike

    def counting(members, *more):
        seen.append((members.select("sig").distinct().count(), (out := beside(members, *more)).count()))
        return out

    def testing(pairs, *more):
        tested.append(pairs.count())
        return alike(pairs, *more)

    monkeypatch.setattr(_shingles, "pairs_beside_pivots", counting)
    monkeypatch.setattr(_shingles, "alike", testing)
    same(simhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), width=5, similar=80).select("doc_id", "component_id"), brute(rows))
    print(f"texts beside pivots and pairs of them: {seen}, pairs tested: {tested}")
    assert seen[0][0] > 300 and seen[0][1] < 4 * seen[0][0]


@pytest.mark.parametrize("stage", ["dedup", "decontamination"])
def test_workers_take_little_memory(stage):
    """Two workers stand beside an executor's JVM and keep what they have once taken: with chunks of a megabyte and more they took what the JVM needed."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(5000)]
    batch = pa.RecordBatch.from_pydict({"_text": [" ".join(rng.choices(vocabulary, k=500)) for _ in range(3000)]})
    marks = SimpleNamespace(value=np.zeros(decontaminate.MARKS // 64, np.uint64))
    tracemalloc.start()
    try:
        if stage == "dedup":
            rows = sum(len(size) for _, _, _, size, _ in _shingles.shingle_sets(batch, 5))
        else:
            rows = sum(len(out) for out in decontaminate._document_prints([], 13, [], marks)([batch]))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    print(f"{batch.nbytes / 1e6:.0f} MB of texts, at most {peak:.0f} MB besides")
    assert rows == 3000 and peak < 24


def stages(spark, run) -> int:
    """Stages that a call runs, without those it skips."""
    context = spark.sparkContext._jsc.sc()

    def ran():
        context.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        found = context.statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {found.apply(i).stageId() for i in range(found.size()) if str(found.apply(i).status()) == "COMPLETE"}

    before = ran()
    run()
    return len(ran() - before)


def test_few_stages(spark):
    """The driver holds figures of every stage and task, threads of every exchange: with many of them it ran out of memory."""
    df = spark.createDataFrame(edited(), SCHEMA).repartition(3)
    took = stages(spark, lambda: simhash_dedup.one_of_each(df).collect())
    print(f"stages of the dedup stage: {took}")
    assert took <= 200
    stars = spark.createDataFrame([(100 * i + j, i) for i in range(5) for j in range(10, 40)], "a long, b long")
    assert stages(spark, lambda: graph.components(stars).collect()) <= 8


def test_shuffle_files_go_with_the_largest_steps(spark, monkeypatch):
    """What the stage shuffles is several times its input: it stayed on disk until the driver's garbage was collected."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before, left, held = shuffled(), [], []
    for name in ("written", "counted"):
        df = spark.range(50_000).select((F.col("id") % 1009).alias("k")).repartition(4, "k").groupBy("k").count().repartition(4, "count")
        held.append((df, checkpointed(freeing(df)) if name == "written" else freeing(df).toArrow()))
        deadline = time.time() + 20
        while (more := shuffled() - before) and time.time() < deadline:
            time.sleep(0.2)
        left.append(len(more))
    assert left == [0, 0] and held[0][1].count() == held[0][0].count() == len(held[1][1]) == 1009  # what was freed can be made again
    seen = []
    monkeypatch.setattr(_shingles, "freeing", lambda df: seen.append(df.columns) or freeing(df))
    simhash_dedup.one_of_each(spark.createDataFrame(edited()[:40], SCHEMA)).count()
    assert seen[:2] == [["slot", "n"], ["key", "n"]] and len(seen) == 4  # the steps that shuffle most
    assert spark.conf.get(FREE) == "false"


def test_common_shingles_in_full_slots(spark, monkeypatch):
    """In a large corpus every slot counts many shingles, so a common passage stood among the first shingles of its texts, and each of these was compared with a pivot: disk grew faster than the input."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(12))
    rows = [" ".join(word() for _ in range(60)) + f" {passage} " + " ".join(word() for _ in range(60)) for _ in range(300)]
    rows = list(enumerate(rows + [r.replace(r.split()[5], "zz", 1) for r in rows[:20]]))
    compared, beside = [], _shingles.pairs_beside_pivots
    monkeypatch.setattr(_shingles, "_slot", lambda shingle: np.zeros(len(shingle), np.int64))
    monkeypatch.setattr(_shingles, "pairs_beside_pivots", lambda members, *more: compared.append(members.count()) or beside(members, *more))
    same(simhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), width=5, similar=80).select("doc_id", "component_id"), brute(rows))
    print(f"sets compared with a pivot: {compared}")
    assert sum(compared) < 30


def test_keys_in_company():
    """Batches that end anywhere, also inside a key and between equal rows."""
    rng = random.Random(6)
    rows = sorted((rng.randint(-9, 9), rng.randint(0, 3)) for _ in range(40)) + [(20, 1), (21, 1), (21, 1)] + [(30, i) for i in range(9)]
    several = {k for k, s in rows if any(k == a and s != b for a, b in rows)}
    for step in (1, 2, 5, len(rows)):
        cut = [rows[i : i + step] for i in range(0, len(rows), step)] + [[]]
        batches = (pa.RecordBatch.from_arrays([pa.array([r[0] for r in c], pa.int64()), pa.array([r[1] for r in c], pa.int64()), *[pa.array([7] * len(c), pa.int64())] * 2], names=["key", "sig", "n", "place"]) for c in cut)
        got = [(k, s) for out in _shingles._in_company(batches) for k, s in zip(out.column("key").to_pylist(), out.column("sig").to_pylist(), strict=True)]
        assert got == sorted({r for r in rows if r[0] in several})
    assert [len(out) for out in _shingles._in_company(iter([]))] == []
