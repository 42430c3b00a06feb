"""Lines from files: ids that stay, in the order of files and lines."""

import random
import time

import pytest

from linepatterns.sources import text
from linepatterns.sources.text import lines_of, matching_files, read_lines


def plan_nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")


@pytest.mark.parametrize("block", ["128m", "1k", "7"])
def test_ids_are_the_same_in_two_scans_and_order_the_lines(spark, tmp_path, block):
    rng = random.Random(4)
    names, lines = ["b.log", "a b%20.log", "ü.log", "x[1]{2}*?#+.log"], {}
    for name in names:
        lines[name] = ["".join(rng.choices("xyé\r ", k=rng.choice([0, 0, 1, 5, 40]))) for _ in range(300 if block != "7" else 30)]
        (tmp_path / name).write_bytes("\n".join(lines[name]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        df = read_lines(spark, [f"{tmp_path}/{n}" for n in names[:3]] + [f"{tmp_path}/x*"])
        first = sorted(tuple(r) for r in df.collect())
        again = sorted(tuple(r) for r in df.where("length(line) >= 0").select("line_id", "line").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert first == again and len({i for i, _ in first}) == len(first)
    want = [x for n in names for x in (lines[n][:-1] if not lines[n][-1] else lines[n])]
    assert [x for _, x in first] == want


def test_files_named_twice_and_folders(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1").write_text("one\n\ntwo")
    (tmp_path / "d" / "_not").write_text("no")
    (tmp_path / "e").write_text("three\n")
    df = read_lines(spark, [f"{tmp_path}/d", f"{tmp_path}/e", f"{tmp_path}/d/1"])
    rows = df.orderBy("line_id").collect()
    assert [r["line"] for r in rows] == ["one", "", "two", "three", "one", "", "two"] and len({r["line_id"] for r in rows}) == 7


def test_many_files_are_one_scan(spark, tmp_path, monkeypatch):
    for i in range(5000):
        (tmp_path / f"{i:05d}").write_text(f"line {i}\n")
    began = time.time()
    df = read_lines(spark, [f"{tmp_path}/*"])
    assert plan_nodes(df) == 1
    took = time.time() - began
    print(f"5,000 files planned in {took:.1f} s")
    assert took < 30 and df.count() == 5000
    monkeypatch.setattr(text, "BROADCAST_FILES", 7)
    few = read_lines(spark, [f"{tmp_path}/0000*"])
    assert plan_nodes(few) == 2 and [r["line"] for r in few.orderBy("line_id").collect()] == [f"line {i}" for i in range(10)]


def test_matches_are_in_order(spark, tmp_path):
    for n in "cab":
        (tmp_path / n).write_text(n)
    assert [p[-1] for p, _ in matching_files(spark, [f"{tmp_path}/b", f"{tmp_path}/*"])] == ["b", "a", "b", "c"]


def test_lines_without_ids_get_ids_that_stay(spark):
    df = lines_of(spark.createDataFrame([(x,) for x in "abcabc"], "line string").repartition(3), "line")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect())) and df.select("line_id").distinct().count() == 6
