"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Only a local session may do without; elsewhere a machine's own folder would lose data."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def freeing(df: DataFrame) -> DataFrame:
    """``df`` as a table whose shuffle files go as soon as an action on it has ended; otherwise they stay until the driver happens to collect its garbage. Meant for one action: another one runs the stages again.

    Not for joins of which Spark may drop a side while a stage of it still reads a shuffle: that stage then asks for files that are gone, and holds a core until its tasks have failed.
    """
    conf = df.sparkSession.conf
    was = conf.get(FREE, "false")
    conf.set(FREE, "true")  # a table keeps what it finds when it is made
    try:
        return df.select("*")
    finally:
        conf.set(FREE, was)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; partitions and the order of their rows stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_name(taken: Iterable[str], start: str) -> str:
    """A column name that begins with ``start`` and that none of ``taken`` begins with, whatever its case."""
    name, lower = f"_{start}", [t.lower() for t in taken]
    while any(t.startswith(name.lower()) for t in lower):
        name = f"_{name}"
    return name
