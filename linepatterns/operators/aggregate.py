"""Support of more specific candidates, added to those that cover them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.sources.shared import written

#: places of a constant that are looked up one by one; neighbours of which a signature knows the pairs
SPREAD, NEAR = 16, 4


def path_nodes(constants: str, gap_min: str, gap_max: str) -> Column:
    """A candidate as a path: a word advances by one, a gap by its least and most words."""
    node = lambda word, lo, hi: F.array(F.struct(word, lo, hi)).cast("array<struct<word:string,lo:int,hi:int>>")
    gap = lambda i: F.filter(node(F.lit(None), F.get(gap_min, i), F.get(gap_max, i)), lambda x: x["hi"] != 0)
    each = F.transform(constants, lambda w, i: F.concat(gap(i), node(w, F.lit(1), F.lit(1))))
    return F.concat(F.flatten(each), gap(F.size(constants)))


def covers(nodes: Column, constants: str, gap_min: str, gap_max: str) -> Column:
    """Whether a candidate covers the path. The first word that fits is taken for good."""
    k = F.size(constants)

    def step(acc: Column, x: Column) -> Column:
        lo, hi, c = acc["lo"] + x["lo"], acc["hi"] + x["hi"], acc["c"]
        state = lambda c, lo, hi, dead: F.struct(c.alias("c"), lo.alias("lo"), hi.alias("hi"), dead.alias("dead"))
        go = state(c, lo, hi, F.lit(False))
        return (
            F.when(acc["dead"], acc)
            .when((c >= k) | (lo - 1 < F.get(gap_min, c)), go)
            .when(hi - 1 > F.get(gap_max, c), state(c, lo, hi, F.lit(True)))
            .when(x["word"].eqNullSafe(F.get(constants, c)), state(c + 1, F.lit(0), F.lit(0), F.lit(False)))
            .otherwise(go)
        )

    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(False).alias("dead"))
    return F.aggregate(nodes, zero, step, lambda a: ~a["dead"] & (a["c"] == k) & (F.get(gap_min, k) <= a["lo"]) & (a["hi"] <= F.get(gap_max, k)))


def rarest_words(candidates: DataFrame) -> DataFrame:
    """(constants, anchor): of each candidate, the constant that fewest candidates hold."""
    words = candidates.select("constants", F.explode(F.array_distinct("constants")).alias("word"))
    usage = words.groupBy("word").agg(F.count("*").alias("n"))
    return words.join(usage, "word").groupBy("constants").agg(F.min(F.struct("n", "word"))["word"].alias("anchor"))


def positions(gaps: str, k: Column) -> Column:
    """Words before each of ``k`` constants, by the gaps before it; the last entry is that of all words."""
    return F.transform(F.sequence(F.lit(0), k), lambda i: i + F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, g: a + g))


def _key(word: Column, at: Column, lead: Column) -> Column:
    """A key of the index; a position or a leading constant that is left open has a value that none has."""
    return F.xxhash64(word, at, F.coalesce(lead.isNotNull(), F.lit(False)), lead)


def _signature(tokens: Column) -> list[Column]:
    """Hashes of the tokens as bits of four numbers. What has all tokens of another has all its bits."""
    h = F.transform(tokens, lambda t: F.pmod(t, F.lit(256)))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    return [F.aggregate(F.filter(h, lambda x: F.shiftright(x, 6) == i), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x))) for i in range(4)]  # noqa: B023


def _tokens(exact_pairs: Column) -> Column:
    """Words, words with their place where it is exact, and pairs of words with the exact number of words between them."""
    own = F.transform("constants", lambda w, i: F.array(F.xxhash64(w), F.when(F.get("low", i) == F.get("high", i), F.xxhash64(w, F.get("low", i)))))
    return F.array_compact(F.concat(F.flatten(own), exact_pairs))


def _pair(i: Column, j: Column) -> Column:
    """The token of the constants i and j, null if the number of words between them varies."""
    apart = lambda at: F.get(at, j) - F.get(at, i)
    return F.when(apart("low") == apart("high"), F.xxhash64(F.get("constants", i), F.get("constants", j), apart("low")))


def indexed(candidates: DataFrame) -> DataFrame:
    """``candidates`` with what the index needs: id, low and high (words before each constant, least and most), lead (the first constant if no gap is before it)."""
    rows = candidates.withColumn("id", F.monotonically_increasing_id()).withColumn("low", positions("gap_min", F.size("constants"))).withColumn("high", positions("gap_max", F.size("constants")))
    return written(rows.withColumn("lead", F.when(F.get("gap_max", 0) == 0, F.get("constants", 0))))


def possible_pairs(rows: DataFrame) -> DataFrame:
    """(general, special): ids of indexed candidates that may cover each other; the rest can't. Pairs may repeat.

    If one covers another, each of its constants stands in the other at a place whose least and most words before it lie between its own least and most;
    so do the words of both as a whole; and without a gap before its first constant, both begin with it. So an entry of the index has a constant, the
    least words before it, and the leading constant, each of the last two also left open. A general candidate looks up that of its constants for which
    it finds fewest entries: with every place from its least to its most words, or with the place open if those are more than ``SPREAD``.
    What is found is kept if its sizes fit and its signature has all bits of the general one's: words, exact places, exact pairs of neighbours.
    """
    k = F.size("constants")
    lead = F.col("lead")
    near = F.flatten(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.transform(F.sequence(F.lit(1), F.lit(NEAR)), lambda d: F.when(i + d < k, _pair(i, i + d)))))
    whole = lambda name: F.get(name, k).alias(f"{name}_all")
    entry = lambda w, i: F.array(*(_key(w, at, first) for at in (F.get("low", i), F.lit(-1)) for first in (lead, F.lit(None).cast("string"))))
    special = rows.select(F.col("id").alias("special"), "n_constants", whole("low"), whole("high"), F.array(*_signature(_tokens(near))).alias("bits"), F.explode(F.array_distinct(F.flatten(F.transform("constants", entry)))).alias("key"))
    next_to = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when((i + 1 < k) & (F.get("gap_max", i + 1) < NEAR), _pair(i, i + 1)))
    asks = F.transform("constants", lambda w, i: F.when(F.get("high", i) - F.get("low", i) > SPREAD, F.array(_key(w, F.lit(-1), lead))).otherwise(F.transform(F.sequence(F.get("low", i), F.get("high", i)), lambda at: _key(w, at, lead))))
    general = rows.where(F.exists("gap_max", lambda g: g != 0))
    asked = general.select("id", F.posexplode(F.array_distinct(asks)).alias("choice", "keys")).select("id", "choice", F.explode(F.array_distinct("keys")).alias("key"))
    held = special.groupBy("key").agg(F.count("*").alias("n"))
    choices = asked.join(held, "key", "left").groupBy("id", "choice").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_list("key").alias("keys"))  # SPREAD keys at most
    best = choices.groupBy("id").agg(F.min_by("keys", F.struct("n", "choice")).alias("keys"))
    own = general.select("id", F.col("n_constants").alias("p_n"), *(whole(c).alias(f"p_{c}") for c in ("low", "high")), F.array(*_signature(_tokens(next_to))).alias("p_bits"))
    looked = own.join(best, "id").select(F.col("id").alias("general"), "p_n", "p_low", "p_high", "p_bits", F.explode("keys").alias("key"))
    fits = (F.col("n_constants") > F.col("p_n")) & (F.col("low_all") >= F.col("p_low")) & (F.col("high_all") <= F.col("p_high"))
    for i in range(4):
        fits &= F.get("p_bits", i).bitwiseAND(F.bitwise_not(F.get("bits", i))) == 0
    return looked.join(special, "key").where(fits).select("general", "special")


def covered(rows: DataFrame) -> DataFrame:
    """(general, special): ids of indexed candidates of which the first covers the second, which has more constants; each pair once."""
    general = rows.select(F.col("id").alias("general"), *(F.col(c).alias(f"p_{c}") for c in ("constants", "gap_min", "gap_max")))
    special = rows.select(F.col("id").alias("special"), path_nodes("constants", "gap_min", "gap_max").alias("nodes"))
    pairs = possible_pairs(rows).distinct().join(general, "general").join(special, "special")
    return pairs.where(covers(F.col("nodes"), "p_constants", "p_gap_min", "p_gap_max")).select("general", "special")


def path_prefixes(candidates: DataFrame) -> DataFrame:
    """Different beginnings of the candidates' paths, the empty one among them: the nodes of their prefix tree."""
    nodes = path_nodes("constants", "gap_min", "gap_max")
    parts = candidates.select(nodes.alias("n")).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("n")), lambda k: F.slice("n", 1, k))).alias("path"))
    return parts.distinct()


def aggregate_supports(candidates: DataFrame) -> DataFrame:
    """``candidates`` with support raised by the own support of each more specific one that they cover."""
    rows = indexed(candidates)
    gained = covered(rows).join(rows.select(F.col("id").alias("special"), F.col("own_support").alias("more")), "special").groupBy(F.col("general").alias("id")).agg(F.sum("more").alias("gained"))
    return rows.join(gained, "id", "left").withColumn("support", F.col("own_support") + F.coalesce("gained", F.lit(0))).select(*candidates.columns)
