"""Language identification by words first, with back-off to shorter and shorter character n-grams.

Training. Of the labelled rows, at most about ``sample`` in all are taken, evenly by language and by a hash of their id; this bound on
labelled rows is the only one. Their words are counted per language, and the n-grams of their words for each length n up to ``longest``,
padded by a space at either end. A word is a run of letters, with the marks that follow them, lower-cased. Every word and n-gram that
was counted is in the model.

Prediction. A word that any language knows scores -log10 of its relative frequency in each language. A language that lacks
it takes the penalty: the score of a frequency one tenth of the rarest. An unseen word falls back to its n-grams of the
greatest length of which any is known, and scores their mean. A text's score is the mean over its words; the smallest wins,
ties by name. ``score`` is the share of the winner when 10 ** -score is spread over the languages, 0 to 1.

The model is a few sorted arrays of 64-bit hashes, languages and scores, so its size follows the sample, not the number of languages
times the number of words.

A text that is null or has no letter is ``und`` with score 0, as is every text if nothing can be learnt. Rows with a null label
or id are never learnt from. A null id is not held out. Repeated rows have equal results; of ``docs`` only ``keep`` and the text are
read, whatever else there is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepatterns.llm._words import checkpointed

_ASCII = re.compile("[a-z]+")
MEMORY = 64 << 20
LANGUAGES = 10_000


def words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return _ASCII.findall(text)
    import regex

    return regex.findall(r"\p{L}[\p{L}\p{M}]*", text)


def grams(word: str, n: int) -> list[str]:
    word = f" {word} " if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def _hash(n: int, gram: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(gram.encode("utf-8", "surrogatepass"), n)


def _count(longest: int):
    """Words (n = 0) and n-grams by language, summed within the task."""
    from collections import Counter

    def count(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
        for lang, found in seen.items():
            tables = [found, *(Counter() for _ in range(longest))]
            for word, k in found.items():
                for n in range(1, longest + 1):
                    for g in grams(word, n):
                        tables[n][g] += k
            for n, table in enumerate(tables):
                items = list(table.items())
                for i in range(0, len(items), 10_000):
                    part = items[i : i + 10_000]
                    hashes = np.fromiter((_hash(n, g) for g, _ in part), np.uint64, len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array(hashes.view(np.int64)), pa.array([k for _, k in part], pa.int64())], names=["lang", "n", "gram", "k"])

    return count


class Model:
    """For each n: hashes in order, and for each of them the languages that know it and their scores."""

    def __init__(self, langs: list[str], n: np.ndarray, gram: np.ndarray, lang: np.ndarray, k: np.ndarray, longest: int):
        self.langs, self.longest = langs, longest
        self.worst = np.zeros((longest + 1, len(langs)))
        self.tables = []
        for size in range(longest + 1):
            rows = np.flatnonzero(n == size)
            rows = rows[np.lexsort((lang[rows], gram[rows]))]
            total = np.bincount(lang[rows], k[rows], len(langs))
            score = -np.log10(k[rows] / total[lang[rows]])
            np.maximum.at(self.worst[size], lang[rows], 1 + score)
            keys, first = np.unique(gram[rows], return_index=True)
            self.tables.append((keys, np.append(first, len(rows)), lang[rows].astype(np.int32), score))

    def scores(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and a row of scores for each of those."""
        keys, first, lang, score = self.tables[size]
        at = np.searchsorted(keys, hashes)
        known = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == hashes) if len(keys) else np.zeros(0, np.int64)
        at = at[known]
        out = np.repeat(self.worst[size][None], len(known), 0)
        n = first[at + 1] - first[at]
        flat = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(at)), n), lang[flat]] = score[flat]
        return known, out

    def words(self, new: list[str]) -> np.ndarray:
        """A row of scores for each word; NaN if nothing of it is known."""
        out = np.full((len(new), len(self.langs)), np.nan)
        known, rows = self.scores(0, np.fromiter((_hash(0, w) for w in new), np.uint64, len(new)))
        out[known] = rows
        left = np.flatnonzero(np.isnan(out[:, 0]))
        for size in range(self.longest, 0, -1):
            if not len(left):
                break
            parts = [grams(new[i], size) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(p) for p in parts])
            known, rows = self.scores(size, np.fromiter((_hash(size, g) for p in parts for g in p), np.uint64, len(owner)))
            count = np.bincount(owner[known], minlength=len(left))
            total = np.zeros((len(left), len(self.langs)))
            np.add.at(total, owner[known], rows)
            some = np.flatnonzero(count)
            out[left[some]] = total[some] / count[some, None]
            left = left[count == 0]
        return out


def _predict(shared, fields: list[str]):
    def predict(batches):
        model: Model = shared.value
        width = max(1, len(model.langs))
        at: dict[str, int] = {}
        scores, used = np.zeros((1024, width)), 0
        for batch in batches:
            langs, sure = [], []
            for text in batch.column("_text").to_pylist():
                found = words(text) if model.langs else []
                new = [w for w in dict.fromkeys(found) if w not in at]
                used += sum(8 * width + 100 + 2 * len(w) for w in new)
                if used > MEMORY:
                    at, new = {}, list(dict.fromkeys(found))
                    scores, used = np.zeros((1024, width)), sum(8 * width + 100 + 2 * len(w) for w in new)
                while len(at) + len(new) > len(scores):
                    scores = np.concatenate([scores, np.zeros_like(scores)])
                for lo in range(0, len(new), 2000):
                    part = new[lo : lo + 2000]
                    scores[len(at) : len(at) + len(part)] = model.words(part)
                    at.update(zip(part, range(len(at), len(at) + len(part)), strict=True))
                s = scores[[at[w] for w in found]] if found else np.zeros((0, 1))
                s = s[~np.isnan(s[:, 0])] if len(s) else s
                if not len(s):
                    known = bool(found)
                    langs.append(model.langs[0] if known else "und")
                    sure.append(1 / len(model.langs) if known else 0.0)
                    continue
                mean = s.mean(0)
                best = int(np.argmin(mean))
                langs.append(model.langs[best])
                sure.append(float(1 / np.sum(10 ** np.clip(mean[best] - mean, -300, 0))))
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=[*fields, "lang_pred", "score"])

    return predict


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", sample: int = 16_000, longest: int = 5) -> Model:
    """A model of all words and n-grams of about ``sample`` labelled rows at most, an equal share of them for each language."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    rows = rows.where("_text is not null")
    share = checkpointed(rows.groupBy("_lang").agg(F.count("*").alias("_all")))
    n = share.count()
    draw = F.pmod(F.xxhash64(F.lit("learn"), F.col("_id")), F.col("_all"))
    rows = rows.join(F.broadcast(share) if n <= LANGUAGES else share, "_lang").where(draw < max(1, sample // max(1, n))).select("_lang", "_text")
    counts = rows.mapInArrow(_count(longest), "lang string, n int, gram long, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k")).toArrow()  # as many as the sampled rows have
    names = counts.column("lang").combine_chunks().dictionary_encode()
    names = names if isinstance(names, pa.DictionaryArray) else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), pa.array([], pa.string()))
    langs = names.dictionary.to_pylist()
    order = np.argsort(np.argsort(np.array(langs, object))) if langs else np.zeros(0, np.int64)
    lang_of = order[np.asarray(names.indices)] if langs else np.zeros(0, np.int64)
    value = lambda c: counts.column(c).to_numpy()
    return Model(sorted(langs), value("n"), value("gram").view(np.uint64), lang_of, value("k"), longest)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score, a row for each row."""
    fields = [f"_f{i}" for i in range(len(keep))]
    base = docs.select(*(F.col(k).alias(f) for k, f in zip(keep, fields, strict=True)), F.col(text).alias("_text"))
    schema = "".join(f"{f} {base.schema[f].dataType.simpleString()}, " for f in fields)
    out = base.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), fields), f"{schema}lang_pred string, score double")
    return out.select(*(F.col(f).alias(k) for k, f in zip(keep, fields, strict=True)), "lang_pred", "score")


def held_out(id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary") if isinstance(id, str) else id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
