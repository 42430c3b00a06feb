"""Command line: ``python -m linepatterns.cli --input 'logs/*.log' --support 100``."""

from __future__ import annotations

import argparse
import logging
from logging.handlers import SysLogHandler

from linepatterns.config import MinerConfig

#: fixed values: names of facilities and their codes
FACILITIES = {
    "kern": 0, "user": 1, "mail": 2, "daemon": 3, "auth": 4, "syslog": 5, "lpr": 6, "news": 7, "uucp": 8, "cron": 9, "authpriv": 10, "ftp": 11, "ntp": 12, "log_audit": 13, "log_alert": 14,
    "local0": 16, "local1": 17, "local2": 18, "local3": 19, "local4": 20, "local5": 21, "local6": 22, "local7": 23,
}
NAME, VERSION = "linepatterns", "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(NAME, description="Mine line patterns from event logs.")
    p.add_argument("--version", action="version", version=f"{NAME} {VERSION}")
    p.add_argument("--input", action="append", required=True, help="path or glob; may be repeated")
    p.add_argument("--support", "-s", help="lines a word or pattern needs, or a percentage with a sign")
    p.add_argument("--rsupport", type=float, help="the same as a percentage")
    p.add_argument("--separator", "-d", default="[ ]+")
    p.add_argument("--byteoffset", "-b", type=int, default=0)
    for name, short in (("lfilter", "f"), ("template", "t")):
        p.add_argument(f"--{name}", f"-{short}")
    for name in ("wfilter", "wsearch", "wreplace"):
        p.add_argument(f"--{name}")
    p.add_argument("--wsize", "-v", type=int, default=0)
    p.add_argument("--csize", "-c", type=int, default=0)
    p.add_argument("--aggrsup", "-a", action="store_true")
    p.add_argument("--wweight", type=float, default=0.0)
    p.add_argument("--weightf", type=int, default=1)
    p.add_argument("--max-line-bytes", type=int, help="cut longer lines into several")
    p.add_argument("--outliers", "-o", help="folder for outlier lines")
    p.add_argument("--outputmode", type=int, nargs="?", const=1, default=0)
    p.add_argument("--detailtoken", action="store_true")
    p.add_argument("--debug", type=int, nargs="?", const=1, default=0)
    p.add_argument("--syslog", nargs="?", const="local2", help="log facility")
    p.add_argument("--initseed", "-i", type=int, help="accepted; results do not depend on it")
    p.add_argument("--wtablesize", "-w", type=int, help="accepted; results do not depend on it")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    log = logging.getLogger("linepatterns")
    log.setLevel(logging.DEBUG if a.debug else logging.INFO)
    shown = logging.StreamHandler()
    shown.setFormatter(logging.Formatter("%(asctime)s %(message)s", "%b %d %H:%M:%S"))
    handlers = [shown]
    if a.syslog:
        if a.syslog.lower() not in FACILITIES:
            parser().error(f"unknown facility {a.syslog}")
        handlers.append(SysLogHandler(facility=FACILITIES[a.syslog.lower()]))
    log.handlers = handlers
    if (a.initseed is not None and a.initseed <= 0) or (a.wtablesize is not None and a.wtablesize <= 0):
        parser().error("initseed and wtablesize are positive")
    keys = ("separator", "byteoffset", "lfilter", "template", "wfilter", "wsearch", "wreplace", "wsize", "csize", "aggrsup", "wweight", "weightf", "outputmode", "detailtoken", "max_line_bytes")
    support = MinerConfig.parse_support(a.support) if a.support else {}
    if a.rsupport is not None and "support" not in support:
        support = {"rsupport": a.rsupport}
    try:
        config = MinerConfig(**support, **{k: getattr(a, k) for k in keys})
    except ValueError as e:
        parser().error(str(e))
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from linepatterns.plans.miner import LineMiner
    from linepatterns.progress import Progress
    from linepatterns.sources.text import read_lines, report_lines, write_outliers

    spark = spark or SparkSession.builder.appName(NAME).getOrCreate()
    with Progress(spark, log, a.debug) as progress, LineMiner(read_lines(spark, a.input), config) as miner:
        progress.stage("lines and words")
        log.info("%d lines, support %d, %d frequent words", miner.n_lines, miner.support, miner.n_frequent)
        progress.total = miner.n_lines
        if not miner.n_frequent:
            return 0
        if a.debug:
            for r in miner.frequent_words.orderBy(F.desc("support"), "word").toLocalIterator():
                log.debug("word %s %d", r["word"], r["support"])
            progress.stage("candidates")
            for r in miner.described_candidates().toLocalIterator():
                log.debug("%s", r["description"])
        progress.stage("clusters")
        for r in report_lines(miner.report()).orderBy("rank").toLocalIterator():
            print(r["value"])
        if a.outliers:
            progress.stage("outliers")
            write_outliers(miner.outliers(), a.outliers)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
