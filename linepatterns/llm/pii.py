"""Personal data: fixed patterns, and bootstrapped contextual extraction, in DataFrame expressions only.

Base spans are leftmost, non-overlapping matches of each kind (email, ip, card, phone) that pass its check; failing matches
are dropped and not tried again. Positions are code points, the end exclusive. The patterns are those of the kinds, written
so that Java neither backs up over long runs nor recurses: possessive, and beginning only where a run begins or where the last
match ended, which finds the same matches.

The method adds spans of kind ``context``. Base entities are the seeds. A *pattern* is the two words (lower-cased, parted by white
space and punctuation, however far back they stand) before a mention; a mention is a base entity or any other identifier-like run
of characters (six or more, an ``@`` or three digits among them) between white space, brackets, quotes, ``,;:=`` and ``|``, so
``mail:x@y.z`` has the pattern that ends in ``mail``. Patterns with ``SUPPORT`` different instances or more enter a graph with the
instances they precede. A pattern's confidence is the sum of its instances' scores over all its occurrences in the corpus,
whatever follows, so everyday words are weak patterns. Seeds score 1; in each of ``ROUNDS`` rounds an instance takes the best
confidence, if ``CONFIDENT``, of the patterns it follows, and so lends it to its other patterns. Mentions after confident patterns
that at least ``SUPPORT`` scored instances back are the new spans.

A text is walked once for each kind of match, in blocks, so the work grows with its length and not with the square of its mentions.
Spans and mentions are written once and used by all later steps. Only counts of patterns and instances are shuffled, summed first;
hashes of patterns are broadcast if there are at most ``BROADCAST`` (8 bytes each) and joined otherwise.

Nulls and empty texts have no spans. Mentions without two words before them have no pattern and are only found as base spans.
Rows with an equal id and text have equal spans, null ids included. Of ``docs`` only the named columns are read; results of
``masked_documents`` have all columns. Names that begin with two underscores are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.llm._words import bit_table, checkpointed, let, on_plain_names

KINDS = ("email", "ip", "card", "phone", "context")
SUPPORT = 3
ROUNDS = 3
CONFIDENT = 0.8
BROADCAST = 100_000
PART = 16
_BLOCK = 256

_AT = r"(?:(?<![{0}])|\G)"
EMAIL = _AT.format(r"A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = _AT.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_GAP = r"\s\"'()\[\]{}<>,;:=|"
_EDGE = r"\"'()\[\]{}<>,.;:=!?&$%#*|"
_BETWEEN = r"[\s" + _EDGE + "]+"
IDENTIFIER = f"(?<![^{_GAP}])[^{_GAP}0-9@]*+[0-9@][^{_GAP}]*+"
_NEAR = 160


def walk(items: Column, state: Column, step, out_type: str) -> Column:
    """What ``step`` gives for each item in turn: step(state, item) -> (next state, output). In blocks, so that outputs are not copied for each item."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    pair = lambda s, o: F.struct(s.alias("state"), o.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        now, out = step(acc["state"], x)
        return pair(now, F.concat(acc["out"], F.array(out)))

    def whole(xs: Column) -> Column:
        block = lambda acc, b: let(F.aggregate(F.slice(xs, b * _BLOCK + 1, _BLOCK), pair(acc["state"], none(out_type)), one), lambda r: pair(r["state"], F.concat(acc["out"], F.array(r["out"]))))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), pair(state, none(f"array<{out_type}>")), block, lambda acc: F.flatten(acc["out"]))

    return let(items, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none(out_type)))


def cut(text: Column, pattern: str, body, otherwise: Column) -> Column:
    """``body`` of the matches of a pattern with the text before each: an array of (gap, m). The gaps come from split()."""
    paired = lambda found: lambda pieces: body(F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("gap"), m.alias("m"))))
    matched = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), paired(found)))
    return F.when(text.rlike(pattern), matched).otherwise(otherwise)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, m) of a pattern's matches."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["m"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))

    kind = "struct<start:int,end:int,m:string>"
    return cut(text, pattern, lambda xs: walk(xs, F.lit(0), step, kind), F.array().cast(f"array<{kind}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), value), F.lit(0), lambda acc, d: acc + d) % 10 == 0


def _valid_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255"))))


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array of (start, end, m)."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    size = lambda x: F.length(_digits(x["m"]))
    return {
        "email": F.when(F.contains(t, F.lit("@")), located(t, EMAIL)).otherwise(none),
        "ip": F.filter(located(t, IP), lambda x: _valid_ip(x["m"])),
        "card": F.when(t.rlike("[0-9](?:[ -]?[0-9]){11}"), F.filter(located(t, CARD), lambda x: F.when(size(x).between(12, 19), _luhn(_digits(x["m"]))).otherwise(False))).otherwise(none),
        "phone": F.when(F.contains(t, F.lit("+")), F.filter(located(t, PHONE), lambda x: size(x).between(9, 15))).otherwise(none),
    }


def _last_words(text: Column) -> Column:
    """The last two words. Those in the last ``_NEAR`` characters are enough if there are three, of which the first may be cut."""
    words = lambda t: F.filter(F.split(F.lower(t), _BETWEEN, -1), lambda w: w != "")
    last = lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2)
    return let(words(F.right(text, F.lit(_NEAR))), lambda w: last(F.when((F.size(w) > 2) | (F.length(text) <= _NEAR), w).otherwise(words(text))))


def identifiers(text: Column) -> Column:
    """Array of (start, end, m, before): identifier-like runs without punctuation at their edges, and the two words before each, or null."""
    kind = "struct<start:int,end:int,m:string,gap:array<string>,own:array<string>>"
    lead = lambda m: F.length(m) - F.length(F.regexp_replace(m, "^[" + _EDGE + "]+", ""))
    bare = lambda m: F.regexp_replace(m, "^[" + _EDGE + "]+|[" + _EDGE + "]+$", "")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        inner = start + lead(x["m"])
        return start + F.length(x["m"]), F.struct(inner.alias("start"), (inner + F.length(bare(x["m"]))).alias("end"), bare(x["m"]).alias("m"), _last_words(x["gap"]).alias("gap"), _last_words(x["m"]).alias("own"))

    def before(xs: Column) -> Column:
        none = F.array().cast("array<string>")
        at = lambda i, field: F.coalesce(F.get(xs, i)[field], none)
        words = lambda i: F.concat(at(i - 2, "own"), at(i - 1, "gap"), at(i - 1, "own"), at(i, "gap"))
        two = lambda w: F.when(F.size(w) > 1, F.concat_ws(" ", F.get(w, F.size(w) - 2), F.get(w, F.size(w) - 1)))
        return F.transform(xs, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), let(words(i), two).alias("before")))

    empty = F.array().cast("array<struct<start:int,end:int,m:string,before:string>>")
    return cut(text, IDENTIFIER, lambda xs: let(walk(xs, F.lit(0), step, kind), before), empty)


def _mentions(text: Column, base: Column) -> Column:
    """Array of (start, end, instance, seed, pattern): base spans, and identifiers that none overlaps. base: (start, kind, end, m)."""
    t = F.coalesce(text, F.lit(""))
    known = F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("seed"), x["end"].alias("end"), x["m"].alias("m"), F.lit(None).cast("string").alias("before")))
    other = F.transform(identifiers(t), lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("seed"), x["end"].alias("end"), x["m"].alias("m"), x["before"].alias("before")))
    like = lambda x: (x["end"] - x["start"] >= 6) & (F.contains(x["m"], F.lit("@")) | (F.length(_digits(x["m"])) >= 3))
    kind = "struct<start:int,end:int,instance:string,seed:boolean,pattern:string>"

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        seed = x["seed"] == 1
        pattern = F.when(seed, state["before"]).otherwise(x["before"])  # a base span begins in the last identifier before it
        now = F.struct(pattern.alias("before"), F.when(seed, F.greatest(state["upto"], x["end"])).otherwise(state["upto"]).alias("upto"))
        use = seed | (like(x) & (x["start"] >= state["upto"]) & ~x["held"])
        return now, F.when(use & pattern.isNotNull(), F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["m"]).alias("instance"), seed.alias("seed"), pattern.alias("pattern"))).cast(kind)

    def held(xs: Column) -> Column:  # whether a base span begins inside
        nxt = lambda i: F.get(xs, i + 1)
        return F.transform(xs, lambda x, i: x.withField("held", F.coalesce((nxt(i)["seed"] == 1) & (nxt(i)["start"] < x["end"]), F.lit(False))))

    start = F.struct(F.lit(None).cast("string").alias("before"), F.lit(0).alias("upto"))
    ordered = F.sort_array(F.concat(known, other))
    return F.filter(walk(let(ordered, held), start, step, kind), lambda m: m.isNotNull())


def _ranked(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["m"].alias("m")))


def scanned(docs: DataFrame, text: str, id: str, keep: list[str]) -> DataFrame:
    """_id, _key (a hash of the text), the ``keep`` columns as _f0 ..., base (start, kind, end) in order and _mentions, a row for each row; written."""
    rows = docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), *(F.col(k).alias(f"_f{i}") for i, k in enumerate(keep)), F.col(text).alias("_text"))
    spans = base_spans(F.col("_text"))
    base = F.sort_array(F.concat(*(_ranked(spans[k], i) for i, k in enumerate(KINDS[:4]))))
    rows = rows.withColumn("_base", base).withColumn("_mentions", _mentions(F.col("_text"), F.col("_base")))
    slim = F.transform("_base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return checkpointed(rows.select("_id", "_key", *(f"_f{i}" for i in range(len(keep))), slim.alias("base"), "_mentions"))


def discovered(rows: DataFrame, docs: DataFrame, text: str, id: str) -> DataFrame:
    """(_i, _k, _found): id and hash of the text, and arrays of (start, end) that the method adds, for rows that have any. rows: what ``scanned`` gives of ``docs``."""
    mentions = rows.where(F.size("_mentions") > 0).select("_id", "_key", F.explode("_mentions").alias("m")).select("_id", "_key", "m.*")
    edges = mentions.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    pair = F.xxhash64(F.split("pattern", " ")[0], F.split("pattern", " ")[1])
    patterns = checkpointed(edges.groupBy("pattern").agg(F.count("*").alias("size"), F.sum("n").alias("mentions")).where(F.col("size") >= SUPPORT).withColumn("pair", pair))
    words = let(F.filter(F.split(F.lower(F.col("_text")), _BETWEEN, -1), lambda w: w != ""), lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda b, i: F.xxhash64(F.get(w, i), b)))
    slim = docs.select(F.col(id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text"))

    def occurrences(texts: DataFrame, of: DataFrame) -> DataFrame:
        keyed = of.select("pair").distinct()
        keyed = F.broadcast(keyed) if of.count() <= BROADCAST else keyed
        return texts.where("_text is not null").select(F.explode(words).alias("pair")).join(keyed, "pair").groupBy("pair").agg(F.count("*").alias("total"))

    # What a pattern occurs in a part of the corpus bounds its confidence from above: everyday words are out before all is counted.
    part = occurrences(slim.where(F.pmod(F.xxhash64("_id", "_key"), F.lit(PART)) == 0), patterns)
    patterns = checkpointed(patterns.join(part, "pair", "left").where(F.col("mentions") >= CONFIDENT * F.coalesce("total", F.lit(0))).select("pattern", "pair"))
    seen = patterns.join(occurrences(slim, patterns), "pair").select("pattern", "total")
    edges = checkpointed(edges.join(seen, "pattern"))  # instances of patterns with support, and the occurrences of each pattern
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    confident = None
    for _ in range(ROUNDS):
        weighed = edges.join(scores, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.max(F.greatest("total", F.lit(1)))).alias("confidence"), F.count_if(F.col("score") > 0).alias("support"))
        confident = weighed.where((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT)).select("pattern", F.least("confidence", F.lit(1.0)).alias("confidence"))
        reached = edges.join(confident, "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
        scores = checkpointed(scores.join(reached, "instance", "left").select("instance", F.greatest("score", F.coalesce("best", F.lit(0.0))).alias("score")))
    new = mentions.where("not seed").join(confident.select("pattern"), "pattern")
    return new.groupBy(F.col("_id").alias("_i"), F.col("_key").alias("_k")).agg(F.collect_set(F.struct("start", "end")).alias("_found"))


def count_kind(spans: Column | str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _with_spans(docs: DataFrame, text: str, id: str, keep: list[str]) -> DataFrame:
    """What ``scanned`` gives, with spans: base ones and those found."""
    rows = scanned(docs, text, id, keep)
    found = discovered(rows, docs, text, id)
    more = F.transform(F.coalesce("_found", F.array().cast("array<struct<start:int,end:int>>")), lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end")))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    return joined.withColumn("spans", F.sort_array(F.concat("base", more))).drop("_i", "_k", "_found", "_mentions")


def personal_data(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, the ``keep`` columns, base and spans (arrays of (start, rank of the kind, end), sorted), a row for each row."""
    return _with_spans(docs, text, id, list(keep)).select(F.col("_id").alias(id), *(F.col(f"_f{i}").alias(k) for i, k in enumerate(keep)), "base", "spans")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span (sorted) replaced by its kind in brackets; of overlapping spans, the first names the whole."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    kind = "struct<at:int,start:int,end:int,kind:int>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        upto = F.greatest(at, s["end"])
        return upto, F.struct(at.alias("at"), s["start"].alias("start"), upto.alias("end"), s["kind"].alias("kind")).cast(kind)

    def block(part: Column, here: Column, base: Column) -> Column:  # only this part of the text is walked for its spans
        return F.array_join(F.transform(part, lambda s: F.concat(F.substring(here, s["at"] - base + 1, s["start"] - s["at"]), F.get(names, s["kind"]))), "")

    def whole(xs: Column) -> Column:
        shown = F.filter(xs, lambda s: s["start"] >= s["at"])
        part = lambda ys, b: F.slice(ys, b * _BLOCK + 1, _BLOCK)
        piece = lambda ys: lambda b: let(part(ys, b), lambda p: block(p, F.substring(text, F.get(p, 0)["at"] + 1, F.get(p, F.size(p) - 1)["start"] - F.get(p, 0)["at"]), F.get(p, 0)["at"]))
        blocks = let(shown, lambda ys: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(ys) - 1) / _BLOCK).cast("int")), piece(ys)), ""))
        return F.concat(blocks, F.substring(text, F.get(xs, F.size(xs) - 1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(walk(spans, F.lit(0), step, kind), whole)).otherwise(text)


def masked_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", length: str | None = None) -> DataFrame:
    """``docs``, all columns, whatever their names, with personal data in the text masked, and the column ``length``, if there is one, set to the length of the new text."""
    columns = [text, id, *[length] * (length in docs.columns)]
    return on_plain_names(docs, _masked_documents, *columns)


def _masked_documents(docs: DataFrame, text: str, id: str, length: str | None = None) -> DataFrame:
    found = _with_spans(docs, text, id, []).where(F.size("spans") > 0).select(F.col("_id").alias("__id"), F.col("_key").alias("__key"), F.col("spans").alias("__spans"))
    found = checkpointed(found.dropDuplicates(["__id", "__key"]))
    has_spans = bit_table(found, F.xxhash64("__id", "__key"))(F.xxhash64(F.col(id), F.xxhash64(F.col(text))))  # other texts need no join
    some = docs.where(has_spans).join(found, F.col(id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__key")), "left")
    some = some.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("__spans"))))
    out = docs.where(~has_spans).unionByName(some.select(docs.columns))
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out
