"""Small logs with known results, and properties that hold for any log."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linepatterns.cli import main
from linepatterns.config import MinerConfig
from linepatterns.functions.regex import anchored_to_rest, java_pattern, parse_template
from linepatterns.functions.text import rewritten, split_words
from linepatterns.plans.miner import LineMiner
from linepatterns.sources.text import read_lines, write_outliers
from linepatterns.streaming.classify import classify, counts

A = ["Interface eth0 down"] * 10 + ["Interface eth1 down"] * 5 + [f"Interface x{i} down" for i in range(20)]
B = ["  foo bar", "foo  bar ", "foo x bar", "foo x y bar z", "", "   ", "bar foo"]
D = [f"Apr 15 12:00:0{i} h{i} sshd[1]: login ok u{i}" for i in range(3)] + ["Apr 15 12:00:09 h1 cron[2]: job run"]
E = ["conn from 10.1.1.1", "conn from 10.1.1.2:80", *["conn from 10.1.1.3"] * 3, "conn from host"]
G = ["Interface eth0 unstable"] * 2 + ["Interface eth1 unstable"] * 3 + ["Interface eth2 up"] * 2 + ["Interface eth3 up"] * 3


def mine(spark, lines, **options):
    return LineMiner(spark.createDataFrame(list(enumerate(lines)), "line_id long, line string"), MinerConfig(**options))


def report(m):
    return {r["pattern"].rstrip(): r["support"] for r in m.report().collect()}


def test_aggregation(spark):
    assert report(mine(spark, A, support=5)) == {"Interface *{1,1} down": 20, "Interface eth0 down": 10, "Interface eth1 down": 5}
    assert report(mine(spark, A, support=5, aggrsup=True)) == {"Interface *{1,1} down": 35, "Interface eth0 down": 10, "Interface eth1 down": 5}
    assert report(mine(spark, A, support=20, aggrsup=True)) == {"Interface *{1,1} down": 35}


def test_positions_and_outliers(spark):
    m = mine(spark, B, support=2)
    assert dict(m.frequent_words.collect()) == {"foo": 5, "bar": 5, "x": 2}
    assert report(m) == {"*{0,1} foo bar": 2, "foo x *{0,1} bar *{0,1}": 2}
    assert m.candidates.count() == 3
    assert sorted(r["line"] for r in m.outliers().collect()) == sorted(["", "   ", "bar foo"])


def test_repeated_words(spark):
    m = mine(spark, ["a a b", "a b", "a a b c"], support=2)
    assert report(m) == {"a a b *{0,1}": 2} and m.candidates.count() == 2


def test_filter_and_template(spark):
    options = {"lfilter": r"(sshd\[[0-9]+\]:.*)", "template": "$1"}
    m = mine(spark, D, support=3, **options)
    assert report(m) == {"sshd[1]: login ok *{1,1}": 3} and [r["line"] for r in m.outliers().collect()] == [D[3]]
    m = mine(spark, D, rsupport=75, **options)
    assert m.support == 3 and len(report(m)) == 1


def test_rewriting(spark):
    m = mine(spark, E, support=2, wfilter="[.:]", wsearch="[0-9]+", wreplace="N")
    assert dict(m.frequent_words.collect()) == {"conn": 6, "from": 6, "N.N.N.N": 4, "10.1.1.3": 3}
    assert {tuple(r["constants"]): r["support"] for r in m.candidates.collect()} == {("conn", "from", "10.1.1.3"): 3, ("conn", "from"): 2, ("conn", "from", "N.N.N.N"): 1}
    for word, search, new, want in [("10.1.1.2:80", "[0-9]+", "N", "N.N.N.N:N"), ("10.20", "[0-9]+", "0", "0.20"), ("a=1=2", "=.+", "=VALUE", "a=VALUE"), ("aabb", "ab", "", ""), ("123x", "^[0-9]", "", "x")]:
        assert plainly_rewritten(word, search, new) == rewritten_by_spark(spark, [word], search, new) == want


def plainly_rewritten(word, search, new):
    for n in range(10_000):
        m = re.search(search, word)
        if m is None or (n and new.startswith(m[0])):
            return word
        word = word[: m.start()] + new + word[m.end() :]
    return None


def rewritten_by_spark(spark, words, search, new):
    c = MinerConfig(support=1, wfilter="(?s).*", wsearch=search, wreplace=new)
    got = [r[0] for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").orderBy("i").select(rewritten(F.col("w"), c)).collect()]
    return got[0] if len(got) == 1 else got


def test_rewriting_again_and_again(spark):
    """Against a loop: classes, anchors, alternatives, groups that are referred to, empty matches, signs beyond 16 bits, dollars and backslashes."""
    rng = random.Random(8)
    words = ["".join(rng.choices("ab0.$\\\n\u00e9\U0001f600", k=rng.randint(1, 14))) for _ in range(120)] + ["0" * 200, "ab" * 30]
    for search, new in [("00", "0"), ("ab", "ba"), ("a.*?b", ""), ("(a|b)\\1", "$"), ("\U0001f600", "\\"), ("b*", "x"), ("^a|b$", "0"), ("\\.|\n", "\u00e9"), ("a+b?", "b"), ("[$]", "$$"), ("(?:0|a)(?=b)", "")]:
        want = [plainly_rewritten(w, search, new) if re.search(search, w) else None for w in words]
        assert rewritten_by_spark(spark, words, search, new) == want, (search, new)
    with pytest.raises(Exception, match="does not end"):
        rewritten_by_spark(spark, ["a"], "a", "ba")


def test_rewriting_needs_no_python(spark):
    df = spark.createDataFrame([("u100",)], "w string").select(rewritten(F.col("w"), MinerConfig(support=1, wfilter="^u", wsearch="00", wreplace="0")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.first()[0] == "u10"


def plainly_split(line, separator):
    out, rest = [], line
    while m := re.search(separator, rest):
        out.append(rest[: m.start()])
        rest = rest[m.end() :]
    return out + [rest] * bool(rest) if line else []


def test_separators_are_anchored_to_what_is_left(spark):
    lines = ["xxab", "xaxb", "bab", "a^b^c", "]^a", "", "x", "axx", "^^a"]
    for separator in ("^x", "^x|b", "[ab]|^x", r"\\^", "[^a]", "[]^]+", "(^x)+", "[^]a]"):
        c = MinerConfig(support=1, separator=separator.replace("\\\\", "\\"))
        if separator in ("[]^]+", "[^]a]"):  # a bracket that begins with its end is not Java's
            continue
        got = [r[0] for r in spark.createDataFrame(list(enumerate(lines)), "i int, line string").orderBy("i").select(split_words(F.col("line"), c)).collect()]
        assert got == [plainly_split(x, c.separator) for x in lines], separator
    assert anchored_to_rest(r"^a[^b^][[:alpha:]^]\^(^c)") == r"\Ga[^b^][[:alpha:]^]\^(\Gc)"


def test_first_fit_is_final(spark):
    lines = ["A B C"] * 1 + ["A z z z z z B C"] + ["A B X B C"] * 3
    m = mine(spark, lines, support=1, aggrsup=True)
    general = [r for r in m.candidates.collect() if r["constants"] == ["A", "B", "C"]]
    assert all(r["support"] == r["own_support"] for r in general)


@pytest.mark.parametrize(("f", "weights"), [(1, [1.0, 0.5333, 0.8333]), (2, [1.0, 0.3, 0.75])])
def test_weights(spark, f, weights):
    m = mine(spark, G, support=2, weightf=f, wweight=0.5)
    got = {r["pos"]: r["weight"] for r in m.word_weights.collect() if r["constants"] == ["Interface", "eth0", "unstable"]}
    assert [round(got[i], 4) for i in range(3)] == weights


def test_joining(spark):
    assert sorted(report(mine(spark, G, support=2, wweight=0.5)).values()) == [2, 2, 3, 3]
    assert report(mine(spark, G, support=2, wweight=0.5, weightf=2)) == {"Interface (eth0|eth1) unstable": 5, "Interface (eth2|eth3) up": 5}
    assert "Interface (eth0) unstable" in report(mine(spark, G, support=2, wweight=0.6, detailtoken=True))
    assert "Interface eth0 unstable" in report(mine(spark, G, support=2, wweight=0.6))
    assert report(mine(spark, G, support=2, wweight=0.9)) == {"Interface (eth0|eth1|eth2|eth3) (unstable|up)": 10}


def test_random_logs(spark):
    rng = random.Random(1)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    plain = mine(spark, lines, support=6)
    want = report(plain)
    assert report(mine(spark, lines, support=6, wsize=7)) == want and report(mine(spark, lines, support=6, csize=5)) == want
    shuffled = lines[:]
    rng.shuffle(shuffled)
    assert report(mine(spark, shuffled, support=6)) == want
    own = plain.candidates.agg(F.sum("own_support")).first()[0]
    assert own == plain.line_keys.count()
    assert sum(want.values()) + plain.outliers().count() == len(lines)
    joined = mine(spark, lines, support=6, wweight=0.4)
    assert sum(report(joined).values()) == sum(want.values())
    raised = mine(spark, lines, support=6, aggrsup=True)
    assert raised.candidates.where("support < own_support").count() == 0
    assert mine(spark, lines, support=1000).outliers().count() == 0


def test_options():
    assert MinerConfig.parse_support("5%") == {"rsupport": 5.0} and MinerConfig.parse_support("-7") == {"support": 7}
    assert parse_template("a$12b$x$0") == ["a", 12, "b", 0, "x", 0] and java_pattern("[[:digit:]]+") == r"[\p{Digit}]+"
    for bad in ({}, {"support": 1, "wfilter": "a"}, {"support": 1, "aggrsup": True, "csize": 3}, {"support": 1, "separator": "x*"}, {"support": 1, "wweight": 2}, {"support": 1, "lfilter": "("}, {"support": 1, "template": "$100"}):
        with pytest.raises(ValueError):
            MinerConfig(**bad)


def test_files_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.log").write_bytes(b"x y\r\nx z\nx y\r")
    assert [r["line"] for r in read_lines(spark, [f"{tmp_path}/a.log", f"{tmp_path}/none", f"{tmp_path}/a.log"]).orderBy("line_id").collect()] == ["x y\r", "x z", "x y\r"] * 2
    (tmp_path / "b.log").write_text("\n".join(A))
    assert main(["--input", f"{tmp_path}/b.*", "-s", "5", "-o", f"{tmp_path}/out"], spark) == 0
    assert "Interface *{1,1} down \nSupport : 20\n" in capsys.readouterr().out
    m = mine(spark, B, support=2)
    write_outliers(m.outliers(), f"{tmp_path}/o")
    assert spark.read.text(f"{tmp_path}/o").count() == 3
    with pytest.raises(SystemExit):
        main(["--input", "x", "-s", "1", "--wfilter", "a"], spark)


def test_stream(spark, tmp_path):
    m = mine(spark, A, support=5)
    spark.createDataFrame([("Interface x9 down", "2024-01-01 00:01:00"), ("other", "2024-01-01 00:02:00"), ("Interface eth0 down", "2024-01-01 00:03:00")], "line string, t string").select("line", F.col("t").cast("timestamp").alias("t")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("line string, t timestamp").parquet(f"{tmp_path}/in")
    q = counts(classify(stream, m.clusters, m.config), "t").writeStream.outputMode("complete").format("memory").queryName("lines_seen").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["pattern"].strip(), r["n"]) for r in spark.table("lines_seen").collect()} == {("Interface *{1,1} down", 2), ("Interface eth0 down", 1)}


@pytest.mark.parametrize("words", [1_000_000, 0])
def test_lines_to_classify_are_not_broadcast(spark, tmp_path, words):
    """A line has a row for each of its words, many times what its file takes: Spark took them for small, and the driver's memory gave out."""
    m = mine(spark, A, support=5)
    spark.createDataFrame([(line,) for line in A + B], "line string").write.parquet(f"{tmp_path}/in")
    found = classify(spark.read.parquet(f"{tmp_path}/in"), m.clusters, MinerConfig(support=5, broadcast_words=words))
    got = found.groupBy(F.trim("pattern").alias("pattern")).count()
    assert {tuple(r) for r in got.collect()} == {("Interface *{1,1} down", 35), ("Interface eth0 down", 10), ("Interface eth1 down", 5)}
    join = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"Join.*\[_word#", x)]
    assert join and all(("BuildRight" if words else "SortMergeJoin") in x for x in join)
