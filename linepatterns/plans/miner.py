"""A mining run: stages that are composed on demand and share what they have in common."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepatterns.config import MinerConfig
from linepatterns.functions.text import candidate_text, cut_lines, pattern_text, token_text
from linepatterns.operators import aggregate, candidates, sketches, vocabulary, weights
from linepatterns.operators.ranks import ranked


class LineMiner:
    """lines: (line_id, line). Each property or method is a DataFrame; only support, the number of frequent words, and the words if they are few reach the driver.

    Frequent words and counted keys are kept for the stages that share them until ``close()``, or the end of a ``with`` block.
    """

    def __init__(self, lines: DataFrame, config: MinerConfig):
        self.lines, self.config, self._held = cut_lines(lines, config.max_line_bytes), config, []

    def __enter__(self) -> LineMiner:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        while self._held:
            self._held.pop().unpersist()

    def _hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._held[-1]

    @cached_property
    def n_lines(self) -> int:
        """From the pass that counts words, unless a sketch has to know the support before it."""
        if self.config.wsize and self.config.support is None:
            return self.lines.count()
        return sum(r["support"] for r in self._counted.where("word is null").collect())

    @cached_property
    def support(self) -> int:
        return self.config.support if self.config.support is not None else int(self.n_lines * self.config.rsupport / 100)

    @cached_property
    def tokens(self) -> DataFrame:
        return vocabulary.tokenise(self.lines, self.config)

    @cached_property
    def word_slots(self) -> np.ndarray:
        """Which slots of the word sketch are frequent."""
        return sketches.frequent_slots(vocabulary.word_slots(self.tokens, self.config), self.config.wsize, self.support)

    @cached_property
    def _counted(self) -> DataFrame:
        kept = sketches.as_bits(self.lines.sparkSession, self.word_slots) if self.config.wsize else None
        return self._hold(vocabulary.counted(self.tokens, self.config, kept))

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self._counted.where("word is not null")

    @cached_property
    def frequent_words(self) -> DataFrame:
        return self._hold(self.vocabulary.where(F.col("support") >= self.support))

    @cached_property
    def n_frequent(self) -> int:
        return self.frequent_words.count()

    @cached_property
    def known(self):
        return candidates.known_words(self.frequent_words, self.config)

    def _keys(self, rewrite: bool | None = None) -> DataFrame:
        return candidates.line_keys(self.tokens, self.frequent_words, self.known, self.config, rewrite)

    @cached_property
    def line_keys(self) -> DataFrame:
        """(line_id, constants, gaps) of the lines with a constant."""
        return self._keys().where(F.size("constants") > 0).select("line_id", "constants", "gaps")

    @cached_property
    def candidate_slots(self) -> np.ndarray:
        """Which slots of the candidate sketch are frequent."""
        return sketches.frequent_slots(self.line_keys.select(sketches.slots_of(F.array("constants"), self.config.csize)), self.config.csize, self.support)

    @cached_property
    def _kept_candidates(self):
        return sketches.as_bits(self.lines.sparkSession, self.candidate_slots) if self.config.csize else None

    @cached_property
    def counted_keys(self) -> DataFrame:
        """Lines by key: one pass over the lines, for candidates, co-occurrence and weights together. Without weights, a sketch drops keys before they are shuffled."""
        keys = self.line_keys
        if self.config.csize and not self.config.wweight:
            keys = keys.where(sketches.holds(self._kept_candidates, F.xxhash64("constants"), self.config.csize))
        return self._hold(candidates.counted_keys(keys))

    @cached_property
    def candidates(self) -> DataFrame:
        """With aggregated support if the run aggregates."""
        found = candidates.candidates(self.counted_keys, self.config, self._kept_candidates)
        if self.config.aggrsup:
            found = aggregate.aggregate_supports(self._hold(found))
        return found

    def described_candidates(self) -> DataFrame:
        """(rank, description): all candidates by support, as the debug output has them."""
        found = self.candidates.withColumn("pattern", pattern_text(F.col("constants"), F.col("gap_min"), F.col("gap_max")))
        found = ranked(found.select("support", "n_constants", "first_line_id", "pattern"), F.desc("support"), "n_constants", F.desc("first_line_id"), "pattern")
        return found.select("rank", candidate_text(F.col("pattern"), F.col("support")).alias("description"))

    @cached_property
    def cooccurrence(self) -> DataFrame:
        """Of all words, from all lines with a constant, also those whose candidates a sketch drops."""
        return weights.cooccurrence(self._keyed_lines)

    @property
    def _keyed_lines(self) -> DataFrame:
        return self.counted_keys.groupBy("constants").agg(F.sum("support").alias("own_support"))

    @cached_property
    def dependency(self) -> DataFrame:
        return weights.dependency(self.cooccurrence)

    @cached_property
    def clusters(self) -> DataFrame:
        """Candidates with enough support, with their pattern."""
        found = self.candidates.where(F.col("support") >= self.support)
        return self._hold(found.withColumn("pattern", pattern_text(F.col("constants"), F.col("gap_min"), F.col("gap_max"))))

    @cached_property
    def word_weights(self) -> DataFrame:
        """Only words that stand together in a cluster are counted together."""
        found = weights.dependency(weights.needed_cooccurrence(self._keyed_lines, self.clusters))
        return weights.word_weights(self.clusters, found, self.config.weightf)

    @cached_property
    def joined(self) -> DataFrame:
        found = weights.join_clusters(self.clusters.drop("pattern"), self.word_weights, self.config.wweight)
        return found.withColumn("pattern", pattern_text(token_text(F.col("tokens"), self.config.detailtoken), F.col("gap_min"), F.col("gap_max")))

    def report(self) -> DataFrame:
        """(rank, pattern, support) and what orders them: by support, or by the number of constants. Rows come in order."""
        found = self.joined if self.config.wweight else self.clusters.withColumn("is_joined", F.lit(False))
        found = found.select("pattern", "support", "n_constants", "first_line_id", "is_joined")
        order = [F.col("n_constants"), F.col("is_joined"), F.desc("first_line_id")] if self.config.outputmode else [F.desc("support"), F.col("n_constants"), F.desc("first_line_id")]
        return ranked(found, *order, "pattern")

    def outliers(self) -> DataFrame:
        """Lines that are in no cluster by their own words; nothing if no word is frequent."""
        if not self.n_frequent:
            return self.lines.where(F.lit(False)).select("line_id", "line")
        keys = self._keys(None if self.config.outliers_use_rewrite else False)
        return candidates.outliers(keys, self.clusters)

    def n_outliers(self) -> int:
        """Without another pass over the lines where they are judged by the keys that clusters were made from."""
        if not self.n_frequent:
            return 0
        if self.config.rewrites and not self.config.outliers_use_rewrite:
            return self.outliers().count()
        return self.n_lines - (self.clusters.agg(F.sum("own_support")).first()[0] or 0)

    def summary(self) -> DataFrame:
        """One row of counts. They come from the words, keys and clusters that the run has counted; lines are read again only if outliers are judged by other words than clusters."""
        words, frequent = self.vocabulary.agg(F.count("*"), F.count_if(F.col("support") >= self.support)).first()
        out = {"support": self.support, "lines": self.n_lines, "words": words, "frequent_words": frequent, "candidates": self.candidates.count(), "clusters": self.clusters.count(), "outliers": self.n_outliers()}
        if self.config.wsize:
            out["word_slots"] = int(self.word_slots.sum())
        if self.config.csize:
            out["candidate_slots"] = int(self.candidate_slots.sum())
        if self.config.aggrsup:
            out["path_prefixes"] = aggregate.path_prefixes(self.candidates).count()
        if self.config.wweight:
            out["joined_clusters"], out["total_clusters"] = self.joined.agg(F.count_if("is_joined"), F.count("*")).first()
        return self.lines.sparkSession.range(1).select(*(F.lit(n).cast("long").alias(name) for name, n in out.items()))
