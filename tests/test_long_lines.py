"""Lines of more words than the C reference's buffer holds."""

import pytest

from linepatterns.config import MinerConfig
from linepatterns.plans.miner import LineMiner

LINES = [" ".join(["head", *(f"w{i}" for i in range(600)), f"tail{n % 2}", "last"]) for n in range(4)]


def mine(spark, **options):
    return LineMiner(spark.createDataFrame(list(enumerate(LINES)), "line_id long, line string"), MinerConfig(support=4, **options))


def test_all_words_count(spark):
    m = mine(spark)
    found = dict(m.frequent_words.collect())
    assert len(found) == 602 and found["last"] == 4
    (r,) = m.report().collect()
    assert r["pattern"].rstrip().endswith("w599 *{1,1} last") and r["support"] == 4


def test_limit_is_an_option(spark):
    m = mine(spark, max_words=512)
    assert len(dict(m.frequent_words.collect())) == 512
    (r,) = m.report().collect()
    assert r["pattern"].rstrip().endswith("w510")
    with pytest.raises(ValueError):
        MinerConfig(support=1, max_words=0)
