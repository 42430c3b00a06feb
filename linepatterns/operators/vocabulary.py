"""Words and their support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.config import MinerConfig
from linepatterns.functions.text import rewritten_words, words_of
from linepatterns.operators import sketches


def tokenise(lines: DataFrame, config: MinerConfig) -> DataFrame:
    """(line_id, line, words), and news, the rewritten words or nulls, if the run rewrites."""
    rows = lines.select("line_id", "line", words_of(F.col("line"), config).alias("words"))
    return rows.withColumn("news", rewritten_words(F.col("words"), config)) if config.rewrites else rows


def exploded(tokens: DataFrame, rewrite: bool = False) -> DataFrame:
    """(line_id, n_words, pos, word), without empty words; with ``new``, the rewritten word, if asked for."""
    if not rewrite:
        return tokens.select("line_id", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word")).where("word <> ''")
    rows = tokens.select("line_id", F.size("words").alias("n_words"), F.posexplode(F.arrays_zip("words", "news")).alias("pos", "w"))
    return rows.select("line_id", "n_words", "pos", F.col("w.words").alias("word"), F.col("w.news").alias("new")).where("word <> ''")


def _both(tokens: DataFrame, config: MinerConfig) -> Column:
    """A line's words and rewritten words, empty ones left out."""
    both = F.concat("words", F.array_compact("news")) if config.rewrites else F.col("words")
    return F.array_remove(both, "")


def word_slots(tokens: DataFrame, config: MinerConfig) -> DataFrame:
    """(slots): the slot of each occurrence of a line's words and rewritten words."""
    return tokens.select(sketches.slots_of(_both(tokens, config), config.wsize).alias("slots"))


def counted(tokens: DataFrame, config: MinerConfig, kept: Column | None = None) -> DataFrame:
    """(word, support): lines that hold a word, and all lines where word is null: one pass counts both.

    Repeats in a line go before anything is shuffled. kept: a sketch's frequent slots; words of other slots go where the line stands.
    """
    words = F.concat(F.array_distinct(_both(tokens, config)), F.array(F.lit(None).cast("string")))
    rows = tokens.select(F.explode(words).alias("word"))
    if kept is not None:
        rows = rows.where(F.col("word").isNull() | sketches.holds(kept, F.xxhash64("word"), config.wsize))
    return rows.groupBy("word").agg(F.count("*").alias("support"))


def histogram(vocab: DataFrame, support: int) -> DataFrame:
    """One row: words, how many of them have a support of 1, up to 2, 5, 10 and 20, and below ``support``; and each as a percentage, truncated to whole numbers and the last to two decimals."""
    upto = {f"upto_{n}": F.col("support") <= n for n in (1, 2, 5, 10, 20)}
    row = vocab.agg(F.count("*").alias("words"), F.count_if(F.col("support") >= support).alias("frequent"), *(F.count_if(c).alias(name) for name, c in upto.items()), F.count_if(F.col("support") < support).alias("below"))
    percent = lambda name: F.when(F.col("words") > 0, F.floor(100 * F.col(name) / F.col("words")))
    last = F.when(F.col("words") > 0, F.round(100 * F.col("below") / F.col("words"), 2))
    return row.select("*", *(percent(name).alias(f"percent_{name}") for name in upto), last.alias("percent_below"))
