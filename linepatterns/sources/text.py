"""Lines from text files or from any DataFrame, and sinks for what is mined."""

from __future__ import annotations

import logging
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linepatterns.functions.text import report_text
from linepatterns.sources.shared import written

log = logging.getLogger("linepatterns")
#: bits of a line_id below the number of its file; files of a scan, whose names are broadcast
FILE_BITS, BROADCAST_FILES = 42, 100_000


def matching_files(spark: SparkSession, patterns: list[str]) -> list[tuple[str, str]]:
    """(path, the same as a URI) of files that Spark's file systems find for the patterns, in order, repeats kept; what matches nothing or may not be read is logged and skipped. A folder stands for the files in it."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    read = jvm.org.apache.hadoop.fs.permission.FsAction.READ

    def readable(files, path) -> tuple[str, str] | None:
        try:
            files.access(path, read)
        except Py4JJavaError as e:
            log.error("%s can't be read: %s", path.toString(), e.java_exception.getMessage())
            return None
        return path.toString(), re.sub(r"^(\w+):///", r"\1:/", path.toUri().toString())  # as Spark writes an empty host

    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(conf)
        found = [f for f in files.globStatus(path) or ()]
        inside = [g for f in found if f.isDirectory() for g in files.listStatus(f.getPath()) if not g.isDirectory() and not g.getPath().getName().startswith(("_", "."))]
        paths = [f.getPath() for f in found if not f.isDirectory()] + sorted((g.getPath() for g in inside), key=lambda x: x.toString())
        if not paths:
            log.error("nothing to read at %s", p)
        with ThreadPoolExecutor(16) as pool:  # each look is a call to the file system
            out += [x for x in pool.map(lambda x, files=files: readable(files, x), paths) if x]
    return out


def _numbered(batches):
    """(file, block, line) -> (file, line_id, line): the file's number, then the start of the block and the lines before it in the block. Rows of a block come together and in order."""
    last, n = None, 0
    for batch in batches:
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(file) != 0) | (np.diff(block) != 0)])[: len(file)])
        if not len(starts):
            continue
        place = np.arange(len(file)) - np.repeat(starts, np.diff([*starts, len(file)]))
        if (file[0], block[0]) == last:
            place[: starts[1] if len(starts) > 1 else None] += n
        last, n = (file[-1], block[-1]), place[-1] + 1
        yield pa.RecordBatch.from_arrays([pa.array(file), pa.array((file << FILE_BITS) + block + place), batch.column("line")], names=["file", "line_id", "line"])


def _lines_in(spark: SparkSession, files: list[tuple[tuple[str, str], int]]) -> DataFrame:
    """(file, line_id, line) of ((path, URI), number): one scan. The numbers are broadcast, so rows keep their order."""
    known = F.broadcast(spark.createDataFrame([(uri, n) for (_, uri), n in files], "path string, file long"))
    text = spark.read.option("lineSep", "\n").text([re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for (path, _), _ in files])
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    file = F.coalesce("file", F.raise_error(F.concat(F.lit("no number for "), "path")).cast("long")).alias("file")
    return rows.join(known, "path", "left").select(file, "block", "line").mapInArrow(_numbered, "file long, line_id long, line string")


def read_lines(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(line_id, line). Only ``\\n`` ends a line. A file named twice is read twice.

    One scan for each ``BROADCAST_FILES`` files. line_id is the number of the file, in the order of the patterns and their matches, then a place in the file:
    the start of the block that Spark reads, in bytes, and the lines before it in that block. A line has one byte at least, so places
    are below the line's own byte offset, and they order the lines. They are the same in every scan with the same
    ``spark.sql.files.maxPartitionBytes``. Files may have 2 ** 42 bytes, and there may be 2 ** 21 of them.
    """
    paths = matching_files(spark, patterns)
    if not paths:
        return spark.createDataFrame([], "line_id long, line string")
    numbers: dict[tuple[str, str], list[int]] = {}
    for i, p in enumerate(paths):
        numbers.setdefault(p, []).append(i)
    once = [(p, n[0]) for p, n in numbers.items()]
    lines = reduce(DataFrame.unionByName, (_lines_in(spark, once[i : i + BROADCAST_FILES]) for i in range(0, len(once), BROADCAST_FILES)))
    if len(once) < len(paths):
        again = [(n[0], x - n[0]) for n in numbers.values() for x in n]
        more = spark.createDataFrame(again, "first long, later long")
        lines = lines.join(more, F.col("file") == F.col("first")).withColumn("line_id", F.col("line_id") + F.call_function("shiftleft", "later", F.lit(FILE_BITS)))
    return lines.select("line_id", "line")


def lines_of(df: DataFrame, line_col: str, id_col: str | None = None) -> DataFrame:
    """(line_id, line) from any DataFrame. Without a column for ids, lines are numbered in the order they come and written, so that ids stay the same."""
    if id_col is None:
        return written(df.select(F.monotonically_increasing_id().alias("line_id"), F.col(line_col).alias("line")))
    return df.select(F.col(id_col).cast("long").alias("line_id"), F.col(line_col).alias("line"))


def write_outliers(outliers: DataFrame, path: str) -> None:
    outliers.select("line").write.mode("overwrite").option("lineSep", "\n").text(path)


def report_lines(report: DataFrame) -> DataFrame:
    """(rank, value): the report as text in its order, with a blank line before and after it; nothing if there are no clusters."""
    body = report.select("rank", report_text(F.col("pattern"), F.col("support")).alias("value"))
    frame = report.agg(F.count("*").alias("n")).where("n > 0").select(F.explode(F.array(F.lit(0), F.col("n") + 1)).alias("rank"), F.lit("").alias("value"))
    return frame.unionByName(body)


def write_report(report: DataFrame, path: str) -> None:
    """One text file in the order of the report; nothing is written if there are none. Parts are written in order by as many tasks as the report has, and then copied one after another."""
    if report.isEmpty():
        return
    spark = report.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files, parts = target.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    report_lines(report).repartitionByRange("rank").sortWithinPartitions("rank").select("value").write.mode("overwrite").text(parts.toString())
    files.delete(target, True)
    out = files.create(target)
    for part in sorted(f.getPath().toString() for f in files.listStatus(parts) if f.getPath().getName().startswith("part-")):
        source = files.open(jvm.org.apache.hadoop.fs.Path(part))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
        source.close()
    out.close()
    files.delete(parts, True)
