"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame expressions only.

Base figures of a text, over its words: word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed if it has fewer than
10 words or more than a fifth of them lie in five-word windows that occur twice or more in it.

The ratio compares two multinomials over ``BUCKETS`` hashes of words and of pairs of neighbouring words: the raw model counts
every row, the target model every trusted row, in one aggregation. Both are smoothed by adding
``SMOOTH`` to each bucket, the target's in proportion to the raw model. A text's llr is the mean over its features of
log(target / raw), with ``PRIOR`` features of ratio 0 added, so that short texts are judged mildly. A text that doesn't fail the
base rules is kept if llr >= ``THRESHOLD``; the threshold is fixed, so the verdict depends on the text and both models alone.

Nulls and texts without words have no words and fail. Ids are only used to find trusted rows, so repeated rows and null ids
do no harm. Without any trusted row all ratios are 0 and the base rules decide. Columns used inside begin with two underscores, so
other columns of ``docs`` may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.llm._words import let, on_plain_names

BUCKETS = 1 << 15
SMOOTH = 20.0
PRIOR = 20
THRESHOLD = -0.08
BROADCAST = 1_000_000


def word_array(text: Column) -> Column:
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(spaced, " ", -1), "")


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def joined(left: Column, right: Column, by: int) -> Column:
    """Hashes of left[i] and right[i + by], as far as both go."""
    n = F.greatest(F.size(right) - by, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, by + 1, n), lambda a, b: F.xxhash64(a, b))


def repeat_words(h: Column, fours: Column) -> Column:
    """Words in five-word windows that occur twice or more, the first included. Texts without a repeated four-word window are done."""

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        twin = lambda s: F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]), x["i"]))
        places = F.sort_array(F.filter(let(ranked, twin), lambda i: i.isNotNull()))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    return F.when(F.size(F.array_distinct(fours)) < F.size(fours), covered(joined(fours, h, 4))).otherwise(0).cast("long")


OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def _base_rules(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` and the base figures, their names after two underscores; __hashes and __pairs (of neighbours) stay for the ratio."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("__words", word_array(F.col(text))).withColumn("__hashes", hashes(F.col("__words")))
    df = df.withColumn("__pairs", joined(F.col("__hashes"), F.col("__hashes"), 1)).withColumn("__fours", joined(F.col("__pairs"), F.col("__pairs"), 2))
    df = df.withColumns({
        "__n_words": F.size("__words").cast("long"),
        "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "__n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
        "__n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "__n_repeat_words": repeat_words(F.col("__hashes"), F.col("__fours")),
    })
    return df.withColumn("__base_failed", (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words")))


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, text: str, id: str) -> DataFrame:
    """One row with ``weights``: log(target / raw) of each bucket."""
    wanted = trusted_ids.toDF("_trusted").where("_trusted is not null").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(wanted, F.col("_id") == F.col("_trusted"), "left")
    hashed = rows.select("_trusted", hashes(word_array(F.col("_text"))).alias("_hashes")).withColumn("_pairs", joined(F.col("_hashes"), F.col("_hashes"), 1))
    each = hashed.select(F.col("_trusted").isNotNull().cast("long").alias("target"), F.explode(F.concat("_hashes", "_pairs")).alias("hash"))
    counts = each.groupBy(F.col("hash").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    table = every.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"))  # BUCKETS rows
    p_raw = lambda x: (x["raw"] + SMOOTH) / (F.col("all_raw") + SMOOTH * BUCKETS)
    p_target = lambda x: (x["target"] + SMOOTH * BUCKETS * p_raw(x)) / (F.col("all_target") + SMOOTH * BUCKETS)
    return table.select(F.transform("rows", lambda x: F.log(p_target(x) / p_raw(x))).alias("weights"))


def _judged(docs: DataFrame, trusted_ids: DataFrame, text: str, id: str) -> DataFrame:
    weights = log_ratios(docs, trusted_ids, text, id).scalar()
    df = _base_rules(docs, text).withColumn("__weights", weights)  # the optimizer folds this into the next step: rows don't carry it
    total = F.aggregate(F.concat("__hashes", "__pairs"), F.lit(0.0), lambda acc, h: acc + F.get("__weights", h.bitwiseAND(BUCKETS - 1).cast("int")))
    df = df.withColumn("__llr", total / (2 * F.col("__n_words") + PRIOR))
    return df.withColumn("__kept", ~F.col("__base_failed") & (F.col("__llr") >= THRESHOLD))


def judge(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept, a row for each row."""
    return _judged(docs, trusted_ids, text, id).select(*keep, *(F.col(f"__{c}").alias(c) for c in OUTPUTS))


def kept(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs``, all columns, whatever their names, without the rows that are rejected."""
    return on_plain_names(docs, lambda d, t, i: _kept(d, trusted_ids, t, i), text, id)


def _kept(docs: DataFrame, trusted_ids: DataFrame, text: str, id: str) -> DataFrame:
    judged = _judged(docs, trusted_ids, text, id).withColumn("__row", F.monotonically_increasing_id())
    return judged.where("__kept and __row >= 0").select(docs.columns)  # a row number keeps Spark from pushing the verdict, and all it rests on, into the scan once more
