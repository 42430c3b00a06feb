"""New lines matched against mined patterns, as a stream or a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepatterns.config import MinerConfig
from linepatterns.functions.text import words_of
from linepatterns.operators.aggregate import covers, rarest_words


def classify(lines: DataFrame, clusters: DataFrame, config: MinerConfig) -> DataFrame:
    """``lines`` (any columns, among them line) with the patterns that cover each. Stateless: it works on streams.

    A line meets the clusters whose rarest constant it holds by an equi-join, and then their gaps are tested. clusters: constants,
    gap_min, gap_max, pattern, as mined; static. They are counted first: at ``broadcast_words`` and ``broadcast_bytes`` or fewer they are
    broadcast, otherwise both sides are shuffled. Spark doesn't choose, as it takes a line's rows, one for each word, for little more than the file they come from.
    """
    node = lambda w: F.struct(w.alias("word"), F.lit(1).alias("lo"), F.lit(1).alias("hi"))
    words = lines.withColumn("_words", words_of(F.col("line"), config))
    rows = words.withColumn("_word", F.explode(F.array_distinct("_words")))
    anchor = rarest_words(clusters)
    known = clusters.join(anchor, "constants").select(F.col("anchor").alias("_word"), F.col("constants").alias("_c"), F.col("gap_min").alias("_lo"), F.col("gap_max").alias("_hi"), "pattern")
    n, size = known.agg(F.count("*"), F.sum(F.octet_length("pattern") + F.octet_length(F.array_join("_c", "")) + 16 * F.size("_c"))).first()
    few = n <= config.broadcast_words and (size or 0) <= config.broadcast_bytes
    found = rows.join(F.broadcast(known) if few else known.hint("merge"), "_word").where(covers(F.transform("_words", node), "_c", "_lo", "_hi"))
    return found.select(*lines.columns, "pattern")


def counts(classified: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines of each pattern by window of event time."""
    return classified.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "pattern").agg(F.count("*").alias("n"))
