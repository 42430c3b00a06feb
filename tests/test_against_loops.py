"""Whole runs against the plain miner on random lines, ranks included; and what the report, files and options do."""

import logging
import random

import pytest
from pyspark.sql import functions as F

from linepatterns.cli import main
from linepatterns.config import MinerConfig
from linepatterns.plans.miner import LineMiner
from linepatterns.sources.text import read_lines, write_report
from tests.plain_miner import Plain

RUNS = [
    {"support": 8},
    {"rsupport": 3.0, "outputmode": 1},
    {"support": 5, "aggrsup": True},
    {"support": 6, "wfilter": "^[ab]", "wsearch": "[0-9]+", "wreplace": "N"},
    {"support": 6, "wfilter": "[ab]", "wsearch": "00", "wreplace": "0", "aggrsup": True},
    {"support": 6, "wweight": 0.5},
    {"support": 6, "wweight": 0.6, "weightf": 2, "detailtoken": True, "outputmode": 1},
    {"support": 5, "wweight": 0.45, "wfilter": "^[ab]", "wsearch": "[0-9]+", "wreplace": "N"},
    {"support": 6, "byteoffset": 3, "separator": "[ ,]+"},
    {"support": 4, "lfilter": "c (.*) ?d", "template": "x $1 $0"},
]


def log(seed, n=240):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "d", "e", "f", "éü", "a1", "a22", "b100", "b1000", "a00300", "g" * 40]) + rng.choice(["", "", "", str(rng.randint(0, 30))])
    fixed = ["c start d", "b run é c", "a c d a"]
    lines = ["é " + rng.choice(["", " ", "  "]) + rng.choice([" ", ", ", "  "]).join([*rng.choice(fixed).split(), *(word() for _ in range(rng.randint(0, 4)))]) + rng.choice(["", " "]) for _ in range(n)]
    return [*lines, "", "   ", "é "]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("at", range(len(RUNS)))
def test_run(spark, at, small):
    """small: with the frequent words at hand, or by joins."""
    lines = log(at)
    want = Plain(lines, **RUNS[at])
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string").repartition(4)
    with LineMiner(df, MinerConfig(**RUNS[at], broadcast_words=1_000_000 if small else -1)) as m:
        assert m.support == want.s and dict(m.vocabulary.collect()) == want.words
        assert {tuple(r["constants"]): (r["support"], r["own_support"], r["gap_min"], r["gap_max"], r["first_line_id"]) for r in m.candidates.collect()} == {k: (want.support[k], c[0], c[1], c[2], c[3]) for k, c in want.candidates.items()}
        assert [(r["rank"], r["pattern"], r["support"]) for r in m.report().collect()] == [(i + 1, *r) for i, r in enumerate(want.report)] and want.report
        assert sorted(r["line_id"] for r in m.outliers().collect()) == want.outliers
        if want.weights:
            got = {(tuple(r["constants"]), r["pos"]): r["weight"] for r in m.word_weights.collect()}
            assert got.keys() == {(k, i) for k, x in want.weights.items() for i in range(len(x))} and all(abs(got[k, i] - x[i]) < 1e-12 for k, x in want.weights.items() for i in range(len(x)))
    assert not m._held


def test_report_file(spark, tmp_path):
    lines = [*["x y"] * 3, *["x z"] * 2]
    m = LineMiner(spark.createDataFrame(list(enumerate(lines)), "line_id long, line string"), MinerConfig(support=2))
    write_report(m.report(), f"{tmp_path}/r")
    assert (tmp_path / "r").read_text() == "\nx y \nSupport : 3\n\nx z \nSupport : 2\n\n\n"
    none = LineMiner(spark.createDataFrame(list(enumerate(lines)), "line_id long, line string"), MinerConfig(support=9))
    write_report(none.report(), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists() and not (tmp_path / "r.parts").exists()
    many = spark.createDataFrame([(i, f"w{i:03d}") for i in range(300)] * 2, "line_id long, line string").repartition(9)
    write_report(LineMiner(many, MinerConfig(support=2)).report(), f"{tmp_path}/r")  # over the one that is there
    assert (tmp_path / "r").read_text() == "\n" + "".join(f"w{i:03d} \nSupport : 2\n\n" for i in range(299, -1, -1)) + "\n"


def test_long_lines_are_cut_if_asked(spark):
    df = spark.createDataFrame([(1, "ab cdé"), (2, ""), (3, "abcd"), (4, None)], "line_id long, line string")
    m = LineMiner(df, MinerConfig(support=1, max_line_bytes=4))
    assert [(*r["line_id"], r["line"]) for r in m.lines.orderBy("line_id").collect()] == [(1, 0, "ab c"), (1, 1, "dé"), (2, 0, ""), (3, 0, "abcd")] and m.n_lines == 4
    assert [(r["pattern"], tuple(r["first_line_id"])) for r in m.report().where("pattern like 'd%'").collect()] == [("dé ", (1, 1))]
    assert {tuple(r["line_id"]) for r in m.outliers().collect()} == {(2, 0)}
    with pytest.raises(ValueError):
        MinerConfig(support=1, max_line_bytes=0)


def test_messages(spark, tmp_path, capsys, caplog):
    (tmp_path / "a.log").write_text("x y\nx y\nx z\n")
    with caplog.at_level(logging.DEBUG, "linepatterns"):
        assert main(["--input", f"{tmp_path}/*.log", "--input", f"{tmp_path}/none", "-s", "2", "--debug=2", "--max-line-bytes", "100"], spark) == 0
    said = [r.getMessage() for r in caplog.records]
    assert any("nothing to read" in x for x in said)
    assert [x for x in said if x.startswith(("word", "candidate", "stage"))] == ["stage: lines and words", "word x 3", "word y 2", "stage: candidates", "candidate 2 x y ", "candidate 1 x *{1,1}", "stage: clusters"]
    assert capsys.readouterr().out == "\nx y \nSupport : 2\n\n\n"
    assert main(["--input", f"{tmp_path}/*.log", "-s", "9"], spark) == 0 and capsys.readouterr().out == ""
    for bad in (["--syslog=nothing"], ["--initseed", "0"], ["--wtablesize", "-1"], ["--no-such-option"]):
        with pytest.raises(SystemExit):
            main(["--input", "x", "-s", "1", *bad], spark)
    with pytest.raises(SystemExit) as e:
        main(["--version"], spark)
    assert e.value.code == 0


def test_files_that_cannot_be_read_are_skipped(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text("one\n")
    (tmp_path / "b.log").write_text("two\n")
    (tmp_path / "b.log").chmod(0)
    got = [r["line"] for r in read_lines(spark, [f"{tmp_path}/*.log"]).collect()]
    assert got in (["one"], ["one", "two"])  # the latter where tests run as root
    assert read_lines(spark, [f"{tmp_path}/c*"]).agg(F.count("*")).first()[0] == 0
