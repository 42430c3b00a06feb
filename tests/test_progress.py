"""Lines and time are logged while a stage runs."""

import logging
import time

import pytest

from linepatterns.progress import Progress


def slow(batches):
    for batch in batches:
        time.sleep(0.4)
        yield batch


@pytest.mark.parametrize(("level", "total"), [(3, 4000), (2, None), (1, 4000)])
def test_progress(spark, tmp_path, caplog, level, total):
    spark.range(4000).selectExpr("cast(id as string) as value").repartition(40).write.text(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    log = logging.getLogger("linepatterns")
    lines = spark.read.text(f"{tmp_path}/t").mapInArrow(slow, "value string")
    try:
        with caplog.at_level(logging.DEBUG, "linepatterns"), Progress(spark, log, level, total, lines=1000, seconds=0.3, wait=0.05) as progress:
            progress.stage("words")
            lines.count()
            progress.stage("keys")
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    said = [r.getMessage() for r in caplog.records]
    if level == 1:
        assert said == []
        return
    inside = said[said.index("stage: words") + 1 : said.index("stage: keys")]
    read = [int(x.split(" - ")[1].split()[0].replace(",", "")) for x in inside]
    assert read and read == sorted(read) and 0 < read[0] < 4000 and all(" s, words" in x for x in inside)
    assert all(x.startswith(f"{n / 40:.2f}% finished - {n:,} lines out of 4,000" if total else "UNKNOWN% finished") for n, x in zip(read, inside, strict=True))
    assert len(read) >= (3 if level == 3 else 1)


def test_many_lines_are_one_message(spark, caplog):
    """Level 2 speaks when another thousand is full, not at each look."""
    log, counts = logging.getLogger("linepatterns"), iter([0, 10, 999, 1000, 1500, 3100, 3200, 5, 1200])
    progress = Progress(spark, log, 2, lines=1000, wait=0.001)
    progress.read = lambda: next(counts)  # the end of the counts ends the thread as a session's end does
    with caplog.at_level(logging.DEBUG, "linepatterns"), progress:
        progress._thread.join(10)
    assert [r.getMessage().split(" - ")[1].split()[0] for r in caplog.records if " - " in r.getMessage()] == ["1,000", "3,100", "1,200"]
