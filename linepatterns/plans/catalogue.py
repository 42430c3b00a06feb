"""Queries by name, and the SQL that gives the same rows.

Two logs: ``ev``, a line for each row of events, and ``doc``, the lines of all documents. Thresholds are percentages, so the
queries mean the same at every size.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linepatterns.config import MinerConfig
from linepatterns.functions.text import after_offset, from_template, passes_filter, rewritten
from linepatterns.operators import aggregate, candidates, vocabulary
from linepatterns.plans.miner import LineMiner
from linepatterns.sources.shared import shared_folder
from linepatterns.sources.text import read_lines

PERCENT = 1.0
DOC_PERCENT = 0.05
FILTER = "evt (click|view) (.*)"
TEMPLATE = "T $1 $2"
REWRITE = {"wfilter": "^u", "wsearch": "[0-9]+", "wreplace": "N"}
REWRITE_AGAIN = {"wfilter": "^u", "wsearch": "00", "wreplace": "0"}


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = F.when(F.col("value") >= 100, "high").otherwise("low")
    line = F.concat_ws(" ", F.lit("evt"), "event_type", F.lit("user"), F.concat(F.lit("u"), "user_id"), F.lit("amount"), size, "props")
    return e.select(F.col("event_id").alias("line_id"), line.alias("line"))


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select((F.col("doc_id") * 4294967296 + F.col("i")).alias("line_id"), "line")


def config(**options) -> MinerConfig:
    return MinerConfig(**({"rsupport": PERCENT} | options))


def miner(spark: SparkSession, sf_dir: str, **options) -> LineMiner:
    return LineMiner(ev(spark, sf_dir), config(**options))


# ---------------------------------------------------------------- SQL parts

_EV = """ev as (select event_id as line_id, concat_ws(' ', 'evt', event_type, 'user', 'u' || user_id, 'amount', case when value >= 100 then 'high' else 'low' end, props) as line from events)"""
_DOC = """ev as (select doc_id * 4294967296 + i - 1 as line_id, l[i] as line from (select doc_id, string_split(text, chr(10)) as l from documents), unnest(range(1, len(l) + 1)) t(i))"""


def _words(line: str = "line", where: str = "true", separator: str = "[ ]+") -> str:
    """wl: each line's words (none if dropped); tok: a row for each word that isn't empty."""
    return f"""wl as (select line_id, case when coalesce(t, '') = '' then [] else (case when len(a) > 1 and a[len(a)] = '' then a[1:len(a) - 1] else a end) end as words
      from (select line_id, t, regexp_split_to_array(t, '{separator}') as a from (select line_id, case when {where} then {line} else '' end as t from ev))),
    tok as (select line_id, len(words) as nw, words[i] as w, i - 1 as pos from wl, unnest(range(1, len(words) + 1)) r(i) where words[i] <> '')"""


def _support(percent: float = PERCENT) -> str:
    return f"thr as (select cast(trunc(count(*) * {percent}::double / 100) as bigint) as s from ev)"


_VOCAB = "voc as (select w as word, count(distinct line_id) as support from tok group by w), freq as (select word, support from voc, thr where support >= s)"
_REWRITE = "rw as (select line_id, nw, pos, w, case when regexp_matches(w, '^u') and regexp_matches(w, '[0-9]+') then regexp_replace(w, '[0-9]+', 'N', 'g') end as r from tok)"
_REWRITE_AGAIN = "rw as (select line_id, nw, pos, w, case when regexp_matches(w, '^u') and regexp_matches(w, '00') then regexp_replace(w, '00+', '0', 'g') end as r from tok)"
_VOCAB_REWRITE = "voc as (select word, count(distinct line_id) as support from (select line_id, w as word from rw union all select line_id, r from rw where r is not null) group by word), freq as (select word, support from voc, thr where support >= s)"
_CONST = "con as (select line_id, nw, pos, w from tok where w in (select word from freq))"
_CONST_REWRITE = "con as (select line_id, nw, pos, case when w in (select word from freq) then w else r end as w from rw where w in (select word from freq) or r in (select word from freq))"
_KEYS = """keys as (select line_id, list(w order by pos) as c, list(pos order by pos) as p, max(nw) as nw from con group by line_id),
    gap as (select line_id, c, unnest(range(1, len(c) + 2)) as i, p, nw from keys),
    env as (select c, i, min(g) as lo, max(g) as hi from (select c, i, case when i > len(c) then nw - p[len(c)] - 1 when i = 1 then p[1] else p[i] - p[i - 1] - 1 end as g from gap) group by c, i),
    sup as (select c, count(*) as own, min(line_id) as first_line from keys group by c)"""
_CAND = """pat as (select c, string_agg(case when hi <> 0 then '*{' || lo || ',' || hi || '}' || case when i <= len(c) then ' ' else '' end else '' end || case when i <= len(c) then c[i] || ' ' else '' end, '' order by i) as pattern, list(lo order by i) as lo, list(hi order by i) as hi from env group by c),
    cand as (select sup.c, len(sup.c) as k, pattern, lo, hi, own, own as support, first_line from sup join pat on sup.c = pat.c)"""
_CLUSTER = "clu as (select cand.* from cand, thr where support >= s)"
_AGGR = """node as (select c, own, unnest(flatten(list_transform(range(1, k + 2), lambda i: list_concat(case when hi[i] <> 0 then [{'w': cast(null as varchar), 'lo': lo[i], 'hi': hi[i]}] else [] end, case when i <= k then [{'w': c[i], 'lo': cast(1 as bigint), 'hi': cast(1 as bigint)}] else [] end)))) as n, k from cand),
    path as (select c, any_value(own) as own, any_value(k) as k, list(n) as ns from (select c, own, k, n from node) group by c),
    pq as (select p.c as pc, p.k as pk, p.lo as plo, p.hi as phi, q.c as qc, q.own as own, q.ns as ns from cand p join path q on q.k > p.k and list_has_all(q.c, p.c) where list_max(p.hi) > 0),
    fold as (select pc, pk, plo, phi, qc, own, ns, 1 as j, 1 as x, cast(0 as bigint) as lo, cast(0 as bigint) as hi, false as dead from pq
      union all select pc, pk, plo, phi, qc, own, ns, j + 1,
        case when x <= pk and lo2 - 1 >= plo[x] and hi2 - 1 <= phi[x] and ns[j].w = pc[x] then x + 1 else x end,
        case when x <= pk and lo2 - 1 >= plo[x] and hi2 - 1 <= phi[x] and ns[j].w = pc[x] then 0 else lo2 end,
        case when x <= pk and lo2 - 1 >= plo[x] and hi2 - 1 <= phi[x] and ns[j].w = pc[x] then 0 else hi2 end,
        x <= pk and lo2 - 1 >= plo[x] and hi2 - 1 > phi[x]
      from (select *, lo + ns[j].lo as lo2, hi + ns[j].hi as hi2 from fold where j <= len(ns) and not dead)),
    gain as (select pc, sum(own) as gained from fold where j = len(ns) + 1 and not dead and x = pk + 1 and plo[pk + 1] <= lo and hi <= phi[pk + 1] group by pc),
    agg as (select c, pattern, k, cast(own + coalesce(gained, 0) as bigint) as support from cand left join gain on c = pc)"""
_COVERED = """lw as (select line_id, words, list_transform(words, lambda w: {'w': w, 'lo': 1, 'hi': 1}) as ns from wl),
    pl as (select pattern, c as pc, k as pk, lo as plo, hi as phi, line_id, ns from clu join lw on list_has_all(words, c)),
    fold as (select pattern, pc, pk, plo, phi, line_id, ns, 1 as j, 1 as x, cast(0 as bigint) as lo, cast(0 as bigint) as hi, false as dead from pl
      union all select pattern, pc, pk, plo, phi, line_id, ns, j + 1,
        case when x <= pk and lo2 - 1 >= plo[x] and hi2 - 1 <= phi[x] and ns[j].w = pc[x] then x + 1 else x end,
        case when x <= pk and lo2 - 1 >= plo[x] and hi2 - 1 <= phi[x] and ns[j].w = pc[x] then 0 else lo2 end,
        case when x <= pk and lo2 - 1 >= plo[x] and hi2 - 1 <= phi[x] and ns[j].w = pc[x] then 0 else hi2 end,
        x <= pk and lo2 - 1 >= plo[x] and hi2 - 1 > phi[x]
      from (select *, lo + ns[j].lo as lo2, hi + ns[j].hi as hi2 from fold where j <= len(ns) and not dead)),
    cov as (select pattern, count(*) as n from fold where j = len(ns) + 1 and not dead and x = pk + 1 and plo[pk + 1] <= lo and hi <= phi[pk + 1] group by pattern)"""
_PATHS = """steps as (select c, flatten(list_transform(range(1, k + 2), lambda i: list_concat(case when hi[i] <> 0 then ['*{' || lo[i] || ',' || hi[i] || '}'] else [] end, case when i <= k then ['=' || c[i]] else [] end))) as ns from cand),
    heads as (select distinct ns[1:j] as head from steps, unnest(range(0, len(ns) + 1)) t(j))"""
_DEP = """pairs as (select own, unnest(list_distinct(c)) as w1, list_distinct(c) as d from sup), cooc as (select w1, w2, cast(sum(own) as bigint) as n from (select w1, unnest(d) as w2, own from pairs) group by w1, w2),
    dep as (select a.w1, a.w2, a.n / b.n as dep from cooc a join cooc b on b.w1 = a.w1 and b.w2 = a.w1)"""


def _weights(function: int) -> str:
    others = "unnest(c)" if function == 1 else "unnest(list_distinct(c))"
    value = "sum(dep) / count(*)" if function == 1 else "case when count(*) = 1 then 1.0 else (sum(dep) - 1) / (count(*) - 1) end"
    return f"""cp as (select c, i as pos, c[i] as word from clu, unnest(range(1, len(c) + 1)) t(i)), co as (select c, pos, word, {others} as w1 from cp),
    wt as (select c, pos, word, {value} as weight from co join dep on dep.w1 = co.w1 and dep.w2 = co.word group by c, pos, word)"""


def _join(detail: bool) -> str:
    single = "'(' || m || ')'" if detail else "m"
    return f"""mask as (select c, list(case when weight >= 0.5 then word end order by pos) as m from wt group by c), jc as (select clu.*, m, len(list_filter(m, lambda x: x is null)) > 0 as tok from clu join mask on clu.c = mask.c),
    je as (select m, tok, i, min(lo[i]) as lo, max(hi[i]) as hi from jc, unnest(range(1, len(c) + 2)) t(i) group by m, tok, i),
    jt as (select m, tok, i, string_agg(distinct c[i], '|' order by c[i]) as m1, count(distinct c[i]) as nw, any_value(m[i] is null) as masked from jc, unnest(range(1, len(c) + 1)) t(i) group by m, tok, i),
    jn as (select m, tok, cast(sum(support) as bigint) as support, count(*) as n_members, min(first_line) as first_line, any_value(k) as k from jc group by m, tok),
    jp as (select je.m, je.tok, string_agg(case when hi <> 0 then '*{{' || lo || ',' || hi || '}}' || case when jt.i is not null then ' ' else '' end else '' end || case when jt.i is null then '' when nw > 1 then '(' || m1 || ') ' when masked then {single.replace("m", "m1")} || ' ' else m1 || ' ' end, '' order by je.i) as pattern
      from je left join jt on je.m is not distinct from jt.m and je.tok = jt.tok and je.i = jt.i group by je.m, je.tok),
    joined as (select pattern, support, n_members, jp.tok as is_joined, first_line, k from jp join jn on jp.m is not distinct from jn.m and jp.tok = jn.tok)"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {select}"


def _mined(*more: str, select: str, source: str = _EV, words: str | None = None, percent: float = PERCENT, rewrite: str | None = None, recursive: bool = False) -> str:
    vocab = (rewrite, _VOCAB_REWRITE, _CONST_REWRITE) if rewrite else (_VOCAB, _CONST)
    return _with(source, words or _words(), _support(percent), *vocab, _KEYS, _CAND, *more, select=select, recursive=recursive)


# ---------------------------------------------------------------- queries


def line_count(spark, sf_dir):
    return doc(spark, sf_dir).agg(F.count("*").alias("n"))


def byteoffset_lines(spark, sf_dir):
    return ev(spark, sf_dir).select("line_id", after_offset(F.col("line"), 4).alias("line"))


def lfilter_lines(spark, sf_dir):
    return ev(spark, sf_dir).where(passes_filter(F.col("line"), config(lfilter=FILTER)))


def template_lines(spark, sf_dir):
    c = config(lfilter=FILTER, template=TEMPLATE)
    return ev(spark, sf_dir).where(passes_filter(F.col("line"), c)).select("line_id", from_template(F.col("line"), c).alias("line"))


def tokenize(spark, sf_dir):
    rows = vocabulary.exploded(vocabulary.tokenise(doc(spark, sf_dir), config()))
    return rows.select("line_id", F.col("pos").cast("long").alias("pos"), "word")


def word_support(spark, sf_dir):
    return LineMiner(doc(spark, sf_dir), config(support=1)).vocabulary


def frequent_words(spark, sf_dir):
    return LineMiner(doc(spark, sf_dir), config(rsupport=DOC_PERCENT)).frequent_words


def relative_support(spark, sf_dir):
    m = LineMiner(doc(spark, sf_dir), config(rsupport=DOC_PERCENT))
    return spark.range(1).select(F.lit(m.n_lines).cast("long").alias("lines"), F.lit(m.support).cast("long").alias("support"))


def word_histogram(spark, sf_dir):
    m = LineMiner(doc(spark, sf_dir), config(rsupport=DOC_PERCENT))
    return vocabulary.histogram(m.vocabulary, m.support)


def word_rewrite(spark, sf_dir):
    words = vocabulary.exploded(vocabulary.tokenise(ev(spark, sf_dir), config())).select("word").distinct()
    return words.withColumn("new", rewritten(F.col("word"), config(**REWRITE))).where("new is not null")


def word_support_rewrite(spark, sf_dir):
    return miner(spark, sf_dir, **REWRITE).vocabulary


def _candidates(m: LineMiner) -> DataFrame:
    from linepatterns.functions.text import pattern_text

    return m.candidates.select(pattern_text(F.col("constants"), F.col("gap_min"), F.col("gap_max")).alias("pattern"), "support")


def candidate_patterns(spark, sf_dir):
    return _candidates(miner(spark, sf_dir))


def clusters(spark, sf_dir):
    return miner(spark, sf_dir).report().select("pattern", "support")


def clusters_documents(spark, sf_dir):
    return LineMiner(doc(spark, sf_dir), config(rsupport=DOC_PERCENT)).report().select("pattern", "support")


def clusters_by_constants(spark, sf_dir):
    return miner(spark, sf_dir, outputmode=1).report().select("pattern", F.col("n_constants").cast("long").alias("n_constants"), "support")


def clusters_ranked(spark, sf_dir):
    """The report in its order: by support."""
    return miner(spark, sf_dir).report().select("rank", "pattern", "support")


def clusters_ranked_by_constants(spark, sf_dir):
    return miner(spark, sf_dir, outputmode=1).report().select("rank", "pattern", "support")


def join_clusters_ranked(spark, sf_dir):
    """Joined and other clusters in one order."""
    return miner(spark, sf_dir, wweight=0.5, outputmode=1).report().select("rank", "pattern", "support", "is_joined")


def clusters_separator(spark, sf_dir):
    """Another separator, over lines with commas and tabs."""
    lines = ev(spark, sf_dir).withColumn("line", F.regexp_replace("line", " user ", ",\t user,"))
    return LineMiner(lines, config(separator="[ \t,]+")).report().select("pattern", "support")


def clusters_byteoffset_multibyte(spark, sf_dir):
    """An offset in bytes behind characters of two bytes."""
    lines = ev(spark, sf_dir).withColumn("line", F.concat(F.lit("\u00e9\u00fc "), "line"))
    return LineMiner(lines, config(byteoffset=5)).report().select("pattern", "support")


def clusters_byteoffset(spark, sf_dir):
    return miner(spark, sf_dir, byteoffset=4).report().select("pattern", "support")


def clusters_filtered(spark, sf_dir):
    return miner(spark, sf_dir, lfilter=FILTER, template=TEMPLATE).report().select("pattern", "support")


def clusters_rewrite(spark, sf_dir):
    return miner(spark, sf_dir, **REWRITE).report().select("pattern", "support")


def word_rewrite_again(spark, sf_dir):
    """Words rewritten until nothing matches: zeros in a row become one."""
    words = vocabulary.exploded(vocabulary.tokenise(ev(spark, sf_dir), config())).select("word").distinct()
    return words.withColumn("new", rewritten(F.col("word"), config(**REWRITE_AGAIN))).where("new is not null")


def clusters_rewrite_again(spark, sf_dir):
    return miner(spark, sf_dir, **REWRITE_AGAIN).report().select("pattern", "support")


def join_clusters_rewrite(spark, sf_dir):
    """Rewriting and word weights together."""
    return _joined(miner(spark, sf_dir, wweight=0.5, **REWRITE))


def weights_rewrite(spark, sf_dir):
    return _weights_of(miner(spark, sf_dir, **REWRITE))


def word_sketch_filter(spark, sf_dir):
    return miner(spark, sf_dir, wsize=5000).report().select("pattern", "support")


def candidate_sketch_filter(spark, sf_dir):
    return miner(spark, sf_dir, csize=5000).report().select("pattern", "support")


def aggregate_supports(spark, sf_dir):
    return _candidates(miner(spark, sf_dir, aggrsup=True))


def covered_candidates(spark, sf_dir):
    """Each pair of candidates of which one covers the other."""
    from linepatterns.functions.text import pattern_text

    rows = aggregate.indexed(miner(spark, sf_dir).candidates)
    named = rows.select("id", pattern_text(F.col("constants"), F.col("gap_min"), F.col("gap_max")).alias("pattern"))
    pairs = aggregate.covered(rows)
    for side in ("general", "special"):
        pairs = pairs.join(named.select(F.col("id").alias(side), F.col("pattern").alias(f"{side}_pattern")), side)
    return pairs.select(*(F.col(f"{side}_pattern").alias(side) for side in ("general", "special")))


def aggregate_clusters(spark, sf_dir):
    return miner(spark, sf_dir, aggrsup=True).report().select("pattern", "support")


def word_cooccurrence(spark, sf_dir):
    return miner(spark, sf_dir).cooccurrence


def word_dependency(spark, sf_dir):
    return miner(spark, sf_dir).dependency.select("w1", "w2", F.round("dep", 6).alias("dep"))


def _weights_of(m: LineMiner) -> DataFrame:
    w = m.word_weights
    return w.select(F.array_join("constants", " ").alias("constants"), F.col("pos").cast("long").alias("pos"), "word", F.round("weight", 6).alias("weight"))


def weights_f1(spark, sf_dir):
    return _weights_of(miner(spark, sf_dir))


def weights_f2(spark, sf_dir):
    return _weights_of(miner(spark, sf_dir, weightf=2))


def _joined(m: LineMiner) -> DataFrame:
    return m.joined.select("pattern", "support", "n_members", "is_joined")


def join_clusters(spark, sf_dir):
    return _joined(miner(spark, sf_dir, wweight=0.5))


def join_clusters_detail(spark, sf_dir):
    return _joined(miner(spark, sf_dir, wweight=0.5, weightf=2, detailtoken=True))


def outliers(spark, sf_dir):
    return miner(spark, sf_dir).outliers()


def outliers_filtered(spark, sf_dir):
    return miner(spark, sf_dir, lfilter=FILTER).outliers()


def outliers_rewrite(spark, sf_dir):
    return miner(spark, sf_dir, **REWRITE).outliers()


def run_summary(spark, sf_dir):
    return miner(spark, sf_dir, wweight=0.5).summary()


def run_summary_aggregate(spark, sf_dir):
    """With aggregated supports and the nodes of the candidates' prefix tree."""
    return miner(spark, sf_dir, aggrsup=True).summary()


def run_summary_sketches(spark, sf_dir):
    """With the slots that a sketch leaves; they depend on the hash, so no SQL gives them."""
    return miner(spark, sf_dir, wsize=5000, csize=5000).summary()


def candidate_descriptions(spark, sf_dir):
    """Candidates as the debug output lists them, by support."""
    return miner(spark, sf_dir).described_candidates()


def clusters_text_source(spark, sf_dir):
    """Through text files, as from a log folder."""
    path = os.path.join(shared_folder(spark), f"ev-{os.urandom(6).hex()}")
    ev(spark, sf_dir).select("line").write.text(path)
    return LineMiner(read_lines(spark, [f"{path}/part-*"]), config()).report().select("pattern", "support")


def classify_lines(spark, sf_dir):
    """Lines that a mined pattern covers, by pattern."""
    from linepatterns.streaming.classify import classify

    m = miner(spark, sf_dir)
    return classify(m.lines, m.clusters, m.config).groupBy("pattern").agg(F.count("*").alias("n"))


_ALL = (
    line_count, byteoffset_lines, lfilter_lines, template_lines, tokenize, word_support, frequent_words, relative_support, word_histogram, word_rewrite, word_support_rewrite,
    candidate_patterns, clusters, clusters_documents, clusters_by_constants, clusters_byteoffset, clusters_filtered, clusters_rewrite, word_sketch_filter, candidate_sketch_filter,
    aggregate_supports, aggregate_clusters, word_cooccurrence, word_dependency, weights_f1, weights_f2, join_clusters, join_clusters_detail, outliers, outliers_filtered, outliers_rewrite, run_summary, clusters_text_source, classify_lines,
    clusters_ranked, clusters_ranked_by_constants, join_clusters_ranked, clusters_separator, clusters_byteoffset_multibyte, word_rewrite_again, clusters_rewrite_again, join_clusters_rewrite, weights_rewrite,
    run_summary_aggregate, run_summary_sketches, candidate_descriptions, covered_candidates,
)


def queries() -> dict:
    return {f.__name__.replace("candidate_patterns", "candidates"): f for f in _ALL}


_FILTERED = f"regexp_matches(line, '{FILTER}')"
_TEMPLATED = f"'T ' || regexp_extract(line, '{FILTER}', 1) || ' ' || regexp_extract(line, '{FILTER}', 2)"
_SHOWN = "select pattern, support from clu"
_OUT = "select ev.line_id, line from ev where (select count(*) from freq) > 0 and line_id not in (select line_id from keys where c in (select c from clu))"


def _outliers(words: str | None = None, rewrite: bool = False) -> str:
    if not rewrite:
        return _mined(_CLUSTER, words=words, select=_OUT)
    # clusters come from rewritten words, a line's own key does not
    own = "own as (select line_id, list(w order by pos) as c from tok where w in (select word from freq) group by line_id)"
    return _mined(_CLUSTER, own, rewrite=_REWRITE, select=_OUT.replace("from keys", "from own"))


def oracle_sql() -> dict[str, str]:
    clusters = _mined(_CLUSTER, select=_SHOWN)
    docs = lambda select, *more: _with(_DOC, _words(), _support(DOC_PERCENT), _VOCAB, *more, select=select)
    upto = ", ".join(f"count(*) filter (support <= {n}) as upto_{n}, cast(floor(100 * count(*) filter (support <= {n}) / count(*)) as bigint) as percent_upto_{n}" for n in (1, 2, 5, 10, 20))
    below = f"{upto}, count(*) filter (support < s) as below, round(100 * count(*) filter (support < s) / count(*), 2) as percent_below"
    rank = lambda order, rows: f"select row_number() over (order by {order}, pattern) as rank, * exclude (k, first_line) from ({rows})"
    by_support, by_constants = "support desc, k, first_line desc", "k, is_joined, first_line desc"
    shown = "select pattern, support, k, first_line{} from clu"
    counts = "(select s from thr) as support, (select count(*) from ev) as lines, (select count(*) from voc) as words, (select count(*) from freq) as frequent_words, (select count(*) from cand) as candidates"
    weights = "select array_to_string(c, ' ') as constants, cast(pos - 1 as bigint) as pos, word, round(weight, 6) as weight from wt"
    joined = "select pattern, support, n_members, is_joined from joined"
    return {
        "line_count": _with(_DOC, select="select count(*) as n from ev"),
        "byteoffset_lines": _with(_EV, select="select line_id, substr(line, 5) as line from ev"),
        "lfilter_lines": _with(_EV, select=f"select line_id, line from ev where {_FILTERED}"),
        "template_lines": _with(_EV, select=f"select line_id, {_TEMPLATED} as line from ev where {_FILTERED}"),
        "tokenize": _with(_DOC, _words(), select="select line_id, cast(pos as bigint) as pos, w as word from tok"),
        "word_support": docs("select word, support from voc"),
        "frequent_words": docs("select word, support from freq"),
        "relative_support": _with(_DOC, _support(DOC_PERCENT), select="select (select count(*) from ev) as lines, s as support from thr"),
        "clusters_ranked": _mined(_CLUSTER, select=rank(by_support, shown.format(""))),
        "clusters_ranked_by_constants": _mined(_CLUSTER, select=rank(by_constants.replace("is_joined, ", ""), shown.format(""))),
        "join_clusters_ranked": _mined(_CLUSTER, _DEP, _weights(1), _join(False), select=rank(by_constants, "select pattern, support, is_joined, k, first_line from joined")),
        "clusters_separator": _mined(_CLUSTER, words=_words("replace(line, ' user ', ',' || chr(9) || ' user,')", separator="[ \\t,]+"), select=_SHOWN),
        "clusters_byteoffset_multibyte": _mined(_CLUSTER, words=_words("substr('\u00e9\u00fc ' || line, 4)"), select=_SHOWN),
        "word_rewrite_again": _with(_EV, _words(), _REWRITE_AGAIN, select="select distinct w as word, r as new from rw where r is not null"),
        "clusters_rewrite_again": _mined(_CLUSTER, rewrite=_REWRITE_AGAIN, select=_SHOWN),
        "join_clusters_rewrite": _mined(_CLUSTER, _DEP, _weights(1), _join(False), rewrite=_REWRITE, select=joined),
        "weights_rewrite": _mined(_CLUSTER, _DEP, _weights(1), rewrite=_REWRITE, select=weights),
        "run_summary_aggregate": _mined(_AGGR, "clu as (select agg.* from agg, thr where support >= s)", _PATHS, recursive=True, select=f"select {counts}, (select count(*) from clu) as clusters, (select count(*) from ({_OUT})) as outliers, (select count(*) from heads) as path_prefixes"),
        "candidate_descriptions": _mined(select="select row_number() over (order by support desc, k, first_line desc, pattern) as rank, 'candidate ' || format('{:,}', support) || ' ' || pattern as description from cand"),
        "classify_lines": _mined(_CLUSTER, _COVERED, recursive=True, select="select pattern, n from cov"),
        "word_histogram": docs(f"select count(*) as words, count(*) filter (support >= s) as frequent, {below} from voc, thr"),
        "word_rewrite": _with(_EV, _words(), _REWRITE, select="select distinct w as word, r as new from rw where r is not null"),
        "word_support_rewrite": _with(_EV, _words(), _support(), _REWRITE, _VOCAB_REWRITE, select="select word, support from voc"),
        "candidates": _mined(select="select pattern, support from cand"),
        "clusters": clusters,
        "clusters_documents": _mined(_CLUSTER, source=_DOC, percent=DOC_PERCENT, select=_SHOWN),
        "clusters_by_constants": _mined(_CLUSTER, select="select pattern, cast(k as bigint) as n_constants, support from clu"),
        "clusters_byteoffset": _mined(_CLUSTER, words=_words("substr(line, 5)"), select=_SHOWN),
        "clusters_filtered": _mined(_CLUSTER, words=_words(_TEMPLATED, _FILTERED), select=_SHOWN),
        "clusters_rewrite": _mined(_CLUSTER, rewrite=_REWRITE, select=_SHOWN),
        "word_sketch_filter": clusters,
        "candidate_sketch_filter": clusters,
        "clusters_text_source": clusters,
        "aggregate_supports": _mined(_AGGR, recursive=True, select="select pattern, support from agg"),
        "covered_candidates": _mined(_AGGR, recursive=True, select="select g.pattern as general, s.pattern as special from fold join pat g on g.c = pc join pat s on s.c = qc where j = len(ns) + 1 and not dead and x = pk + 1 and plo[pk + 1] <= fold.lo and fold.hi <= phi[pk + 1]"),
        "aggregate_clusters": _mined(_AGGR, recursive=True, select="select pattern, support from agg, thr where support >= s"),
        "word_cooccurrence": _mined(_DEP, select="select w1, w2, n from cooc"),
        "word_dependency": _mined(_DEP, select="select w1, w2, round(dep, 6) as dep from dep"),
        "weights_f1": _mined(_CLUSTER, _DEP, _weights(1), select=weights),
        "weights_f2": _mined(_CLUSTER, _DEP, _weights(2), select=weights),
        "join_clusters": _mined(_CLUSTER, _DEP, _weights(1), _join(False), select=joined),
        "join_clusters_detail": _mined(_CLUSTER, _DEP, _weights(2), _join(True), select=joined),
        "outliers": _outliers(),
        "outliers_filtered": _outliers(words=_words("line", _FILTERED)),
        "outliers_rewrite": _outliers(rewrite=True),
        "run_summary": _mined(_CLUSTER, _DEP, _weights(1), _join(False), select=f"select {counts}, (select count(*) from clu) as clusters, (select count(*) from ({_OUT})) as outliers, (select count(*) from joined where is_joined) as joined_clusters, (select count(*) from joined) as total_clusters"),
    }
