"""Columns for lines and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.config import MinerConfig
from linepatterns.functions.regex import anchored_to_rest, java_pattern, parse_template, quote_replacement, replaces_at_once

#: replacements in a word that are tried for all words, and at most
STEPS, MOST_STEPS = 8, 10_000


def cut_lines(lines: DataFrame, limit: int | None) -> DataFrame:
    """(line_id, line) as a reader with a buffer of ``limit`` bytes sees them: each longer line in pieces. line_id becomes (line_id, piece), so pieces stand in order where their line stood."""
    if limit is None:
        return lines
    raw = F.encode("line", "UTF-8")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("line") / limit) - 1, F.lit(0)).cast("int")), lambda i: F.decode(F.substring(raw, i * limit + 1, F.lit(limit)), "UTF-8"))
    pieces = lines.where("line is not null").select("line_id", F.posexplode(parts).alias("piece", "line"))
    return pieces.select(F.struct("line_id", "piece").alias("line_id"), "line")


def after_offset(line: Column, n: int) -> Column:
    """``line`` without its first ``n`` bytes; empty if there are no more."""
    return F.decode(F.substring(F.encode(line, "UTF-8"), n + 1, 2**31 - 1 - n), "UTF-8") if n else line


def passes_filter(line: Column, config: MinerConfig) -> Column:
    return line.rlike(java_pattern(config.lfilter)) if config.lfilter is not None else F.lit(True)


def from_template(line: Column, config: MinerConfig) -> Column:
    """The line that is split into words: by the template if there is a filter for it, else as it is."""
    if config.template is None or config.lfilter is None:
        return line
    pattern = java_pattern(config.lfilter)
    return F.concat(F.lit(""), *(line if p == 0 else F.regexp_extract(line, pattern, p) if isinstance(p, int) else F.lit(p) for p in parse_template(config.template)))


def split_words(line: Column, config: MinerConfig) -> Column:
    """Positional words: a leading separator gives an empty word, a trailing one none, and an empty line no words. ``^`` in the separator is where what is left of the line begins."""
    words = F.split(line, anchored_to_rest(java_pattern(config.separator)), -1)
    size = F.size(words)
    keep = F.when((size > 1) & (F.get(words, size - 1) == ""), size - 1).otherwise(size)
    words = F.slice(words, 1, keep if config.max_words is None else F.least(keep, F.lit(config.max_words)))
    return F.when(F.coalesce(line, F.lit("")) == "", F.array().cast("array<string>")).otherwise(words)


def words_of(line: Column, config: MinerConfig) -> Column:
    """Offset, filter, template and split. Lines that the filter drops have no words."""
    rest = after_offset(line, config.byteoffset)
    return F.when(F.coalesce(rest, F.lit("")) == "", F.array().cast("array<string>")).when(passes_filter(rest, config), split_words(from_template(rest, config), config)).otherwise(F.array().cast("array<string>"))


def _replaced_again(word: Column, search: str, new: str) -> Column:
    """``word`` with the leftmost match replaced and searched again from its start, until nothing matches or, after one replacement, the match is a prefix of ``new``.

    A fold over numbers of steps that stands still once it is done: ``STEPS`` for all words, and ``MOST_STEPS`` more for those that need them. A word that
    needs still more raises an error. The place of a match is the shortest beginning that a match follows.
    """
    before = rf"^[\s\S]*?(?=(?:{search}))"
    state = lambda w, done: F.struct(w.alias("word"), F.lit(done).alias("done"))

    def step(s: Column, i: Column) -> Column:
        w, head, match = s["word"], F.regexp_extract(s["word"], before, 0), F.regexp_extract(s["word"], search, 0)
        ends = ~w.rlike(search) | ((i > 0) & F.lit(new).startswith(match))
        rest = F.call_function("substring", w, F.length(head) + F.length(match) + 1)
        return F.when(s["done"], s).when(ends, state(w, True)).otherwise(state(F.concat(head, F.lit(new), rest), False))

    def fold(w: Column, low: int, high: int) -> Column:
        return F.aggregate(F.sequence(F.lit(low), F.lit(high)), state(w, False), step)

    once = lambda value, body: F.transform(F.array(value), body)[0]
    endless = F.raise_error(F.lit(f"replacing {search} by {new} does not end")).cast("string")
    more = lambda s: once(fold(s["word"], STEPS, MOST_STEPS), lambda t: F.when(t["done"], t["word"]).otherwise(endless))
    return once(fold(word, 0, STEPS - 1), lambda s: F.when(s["done"], s["word"]).otherwise(more(s)))


def rewritten_words(words: Column, config: MinerConfig) -> Column:
    """The rewritten form of each word of an array, null where the filters leave it alone."""
    search, new = java_pattern(config.wsearch), config.wreplace
    fits = lambda w: (w != "") & w.rlike(java_pattern(config.wfilter)) & w.rlike(search)
    if replaces_at_once(config.wsearch, new):
        return F.transform(words, lambda w: F.when(fits(w), F.regexp_replace(w, search, quote_replacement(new))))
    return F.transform(words, lambda w: F.when(fits(w), _replaced_again(w, search, new)))


def rewritten(word: Column, config: MinerConfig) -> Column:
    """The rewritten form of one word, or null."""
    return F.get(rewritten_words(F.array(word), config), 0)


def pattern_text(words: Column, gap_min: Column, gap_max: Column) -> Column:
    """Words with ``*{min,max}`` where others may stand. A pattern that ends with a word ends with a space."""
    gap = lambda i: F.concat(F.lit("*{"), F.get(gap_min, i).cast("string"), F.lit(","), F.get(gap_max, i).cast("string"), F.lit("}"))
    each = F.transform(words, lambda w, i: F.concat(F.when(F.get(gap_max, i) != 0, F.concat(gap(i), F.lit(" "))).otherwise(""), w, F.lit(" ")))
    return F.concat(F.array_join(each, ""), F.when(F.get(gap_max, F.size(words)) != 0, gap(F.size(words))).otherwise(""))


def token_text(tokens: Column, detail: bool) -> Column:
    """Alternatives of each position, sorted: ``(a|b)``, a single one bare, or in brackets too if ``detail`` and the position is a token."""
    joined = lambda t: F.array_join(F.sort_array(t["words"]), "|")
    return F.transform(tokens, lambda t: F.when((F.size(t["words"]) > 1) | (F.lit(detail) & t["is_token"]), F.concat(F.lit("("), joined(t), F.lit(")"))).otherwise(joined(t)))


def candidate_text(pattern: Column, support: Column) -> Column:
    """A candidate as the debug output describes it."""
    return F.concat(F.lit("candidate "), F.format_number(support, 0), F.lit(" "), pattern)


def report_text(pattern: Column, support: Column) -> Column:
    return F.concat(pattern, F.lit("\nSupport : "), F.format_number(support, 0), F.lit("\n"))
