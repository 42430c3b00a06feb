"""Exact token counts at every prefix of a text.

``prefix_counts`` has, for each row, the number of tokens of the first 0, 1, 2 ... characters of its text, so what a truncation
costs (``tokens_up_to``) and how much of a text fits a budget (``fitting_characters``) are look-ups; nothing is encoded again.

Counts at the ends of pieces alone (``every=False``) are a smaller table of the same program, for budgets in whole words.

The dynamic program. A prefix extends a shorter one. White space parts *pieces*, which the tokenizer never joins across, so the count at a place is that of the
pieces before it and of the part of the piece up to it. In a piece, the tokenizer's own pattern parts words, digits and
punctuation. In each of these the last token of every prefix is found from those of shorter prefixes: a byte-pair encoding is right
if and only if each two neighbouring tokens are the encoding of what they spell, so for each place the token that ends there is the
one that its neighbour before it allows, and its count is one more than at the place where it begins. The last token of a prefix has
the end-of-word mark, those before it have none. What may end at a place is told by the longest beginning of a token that ends there, followed letter by letter.
Whether two tokens stand side by side is told by undoing their merges, latest first. Normalisation (NFC, lower case)
is followed along the prefixes: where a mark joins the letter before it, or goes before other marks, the states from before that place go on. What a letter is and what it is
lowered to are asked of the library, once for each letter, as its Unicode is newer than Python's.

Every count is the program's. Different pieces are worked out once for each Python worker, and so are different words of at most ``SHORT`` characters. Of longer pieces, the library's
count of the whole is compared with the program's, and a difference stops the job. The memories of pieces and of words are emptied when they hold ``MEMORY`` bytes together.
Special strings inside a text are tokens of their own, as the library has it by default; a text that ends inside one is ordinary text.

Nulls count as empty texts: no bytes, no tokens, a table of one zero. Repeated rows are rows like any other; of the table only
``keep`` and the text are read.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMORY = 192 << 20
SHORT = 48
#: fixed value: letters below do not change with those beside them, as neither marks nor parts of syllables are among them
LATIN = 0x300
#: fixed values: Unicode's white space, which the tokenizer folds to one space; str.split() would also split on U+001C to U+001F
SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_SPACE = re.compile("[" + "".join(map(chr, SPACES)) + "]+")
_CONTROL = re.compile("[\\x1c-\\x1f]")
_IS_SPACE = np.isin(np.arange(0x3002), SPACES)
_workers: dict[str, Prefixes] = {}


def pieces(text: str) -> list[str]:
    return [p for p in _SPACE.split(text) if p] if _CONTROL.search(text) else text.split()


class Encoding:
    """The merges of a tokenizer file with an end-of-word mark, and what its library makes of letters.

    Tokens are numbers: letters first, then merged ones by rank.
    """

    def __init__(self, path: str, library):
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        model = self.file["model"]
        self.mark = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        merged = {a + b for a, b in pairs}
        letters = [t for t in model["vocab"] if t not in merged]
        self.number = {t: i for i, t in enumerate(letters + [a + b for a, b in pairs])}
        self.parts = [(i, i) for i in range(len(letters))] + [(self.number[a], self.number[b]) for a, b in pairs]
        self.joined = {p: i + len(letters) for i, p in enumerate(self.parts[len(letters) :])}
        self.longest = max(map(len, self.number))
        self.told: dict[int, bool] = {}  # what ``fits`` said of two tokens
        self.bodies = {b: (self.number.get(b, -1), self.number.get(b + self.mark, -1)) for b in {t.removesuffix(self.mark) for t in self.number}}  # the token that is just this, and that with the mark
        self.begun = {b[:i] for b in self.bodies for i in range(len(b) + 1)}
        self.states = _Asked(self._state)
        self._forget()
        # bytes that print stand for themselves, the others for characters from 256 on
        plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b not in (0xAD,)]
        others = iter(range(256, 512))
        self.letter = [chr(b) if b in plain else chr(next(others)) for b in range(256)]
        self.by_byte = dict(enumerate(self.letter))
        self.normal = library.normalizer.normalize_str
        self.lowered = _Asked(lambda c: self.normal(chr(c)))
        self.kinds = _Asked(lambda c: self._kind(library.pre_tokenizer, chr(c)))
        self.same_class = _Asked(lambda ab: all(self.is_mark[ord(c)] and self.lowered[ord(c)] == c for c in ab) and self.normal(ab) == ab and self.normal(ab[::-1]) == ab[::-1])
        special = {t["content"][0] for t in self.file["added_tokens"]}
        known = [chr(c) for c in range(LATIN) if chr(c) not in special and c not in SPACES]
        letters = "".join(c for c in known if self.kinds[ord(c)] not in "!'0" and len(self.lowered[ord(c)]) == 1)
        signs = "".join(c for c in known if self.kinds[ord(c)] == "!" and self.lowered[ord(c)] == c)
        self.simple = re.compile(f"([{letters}]+)([{re.escape(signs)}]*)")  # a word of letters, and signs behind it
        self.is_mark = _Asked(lambda c: c == 0x345 or self.normal("a\u0345" + chr(c)) != "a\u0345" + self.lowered[c])  # U+0345 goes last of all marks

    def _forget(self) -> None:
        """No state is known but the first, and no word was asked for."""
        self.states.clear()
        self.steps = 0
        self.met = "", [self.states[""]], [-1], [0], [0]

    def _state(self, read: str) -> tuple[str, dict, list[tuple[int, int]], list[tuple[int, int]]]:
        """The state in which the longest end of what was read that begins a token is ``read``: this, the next states by letter as far as met, and (size, token) of what ends here without the mark and with it, the longest first."""
        ends = [(n, self.bodies[read[-n:]]) for n in range(len(read), 0, -1) if read[-n:] in self.bodies]
        return read, {}, [(n, t) for n, (t, _) in ends if t >= 0], [(n, t) for n, (_, t) in ends if t >= 0]

    def _next(self, state: tuple, letter: str) -> tuple:
        read = state[0] + letter
        while read not in self.begun:
            read = read[1:]
        self.steps += 1
        found = state[1][letter] = self.states[read]
        return found

    def lower(self, part: str) -> str | None:
        """A part as the library normalises it; None if that isn't letter by letter."""
        if part.isascii():
            return part.lower()
        low = part.translate(self.lowered)
        return low if len(low) == len(part) and (ord(max(part)) < LATIN or self.normal(part) == low) else None

    @staticmethod
    def _kind(pattern, c: str) -> str:
        """The letter itself if it may be part of an ending, else ``a`` for letters, ``0`` for digits and ``!`` for all else."""
        if c in "'strevmld":
            return c
        return "a" if len(pattern.pre_tokenize_str("a" + c)) == 1 else "!" if len(pattern.pre_tokenize_str("!" + c)) == 1 else "0"

    def fits(self, before: int, token: int) -> bool:
        """Whether the encoding of what two tokens spell is these two: no merge across their border comes before those that made them."""
        parts, joined, limit = self.parts, self.joined, 1 << 60
        while True:
            if joined.get((before, token), limit) < limit:
                return False
            later = before > token  # the later made of both is undone first
            for _ in range(2):
                if later:
                    limit, before = before, parts[before][1]
                    if before != limit:
                        break
                else:
                    limit, token = token + 1, parts[token][0]
                    if token != limit - 1:
                        break
                later = not later
            else:
                return True

    def every_prefix(self, word: str) -> list[int]:
        """Tokens of the first 1, 2 ... characters of a word, each as a word of its own: as ``Word``, for a word known to its end, from where it parts from the one asked for before."""
        plain = word.isascii() and word.isprintable()
        coded = b"" if plain else word.encode("utf-8", "surrogatepass")
        letters = word if plain else coded.decode("latin-1").translate(self.by_byte)
        fits, told = self.fits, self.told
        if len(told) > 250_000:
            told.clear()
        if self.steps > 250_000:
            self._forget()
        known, states, last, count, closed = self.met
        same = 0
        for x, y in zip(known, letters, strict=False):
            if x != y:
                break
            same += 1
        tell = told.get
        del states[same + 1 :], last[same + 1 :], count[same + 1 :], closed[same + 1 :]
        state, end = states[same], same
        for letter in letters[same:] if same else letters:
            end += 1
            state = state[1].get(letter) or self._next(state, letter)
            for size, token in state[2]:
                if size == end:
                    last.append(token)
                    count.append(1)
                    break
                start = end - size
                if (ok := tell(pair := last[start] << 20 | token)) is None:
                    ok = told[pair] = fits(last[start], token)
                if ok:
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("no token ends here")
            for size, token in state[3]:
                if size == end:
                    closed.append(1)
                    break
                start = end - size
                if (ok := tell(pair := last[start] << 20 | token)) is None:
                    ok = told[pair] = fits(last[start], token)
                if ok:
                    closed.append(count[start] + 1)
                    break
            else:
                raise ValueError("no token ends here")
            states.append(state)
        self.met = letters, states, last, count, closed
        if len(letters) == len(word):
            return closed[1:]
        return [n for n, b in zip(closed[1:], coded[1:] + b" ", strict=True) if b & 0xC0 != 0x80]  # at the last byte of each character


class _Asked(dict):
    """Answers by letter, each asked for once."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, key):
        return self.setdefault(key, self.ask(key))


class Word:
    """The states of one word (letters, a digit, or punctuation) as it grows: the last token and the count of each open prefix."""

    __slots__ = ("code", "count", "last", "letters")

    def __init__(self, code: Encoding):
        self.code = code
        self.letters: list[str] = []
        self.last: list[int] = [-1]
        self.count = [0]

    def _end(self, n: int, mark: str) -> tuple[int, int]:
        """The last token of the first n letters, and their count."""
        number, last = self.code.number, self.last
        low = max(0, n - self.code.longest)
        tail = "".join(self.letters[low:n]) + mark
        for start in range(low, n):  # the longest first
            token = number.get(tail[start - low :])
            if token is not None and (not start or self.code.fits(last[start], token)):
                return token, self.count[start] + 1
        raise ValueError("no token ends here")

    def grow(self, char: str) -> int:
        """The count of the word with one more character, closed."""
        for b in char.encode("utf-8", "surrogatepass"):
            self.letters.append(self.code.letter[b])
            token, count = self._end(len(self.letters), "")
            self.last.append(token)
            self.count.append(count)
        return self._end(len(self.letters), self.code.mark)[1] if self.code.mark else self.count[-1]

    def cut(self, n: int) -> None:
        del self.letters[n:], self.last[n + 1 :], self.count[n + 1 :]


#: fixed values: the endings that the tokenizer's pattern keeps whole
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: the tokenizer's pattern over kinds of letters
_WORD = re.compile("'(?:s|t|re|ve|m|ll|d)|[astrevmld]+|0|[!']+")


class Running:
    """The count of a text that grows character by character (normalised, without white space)."""

    def __init__(self, code: Encoding):
        self.code = code
        self.done, self.now, self.kind, self.tail = 0, Word(code), "", ""  # tokens of finished words, the word at the end, what it is, and an ending in the making
        self.total = self.before = 0

    def _kind(self, c: str) -> str:
        k = self.code.kinds[ord(c)]
        return "P" if k in "!'" else "N" if k == "0" else "L"

    def _start(self, c: str, kind: str) -> None:
        self.done, self.now, self.kind = self.total, Word(self.code), kind
        self.total = self.done + self.now.grow(c)

    def add(self, c: str) -> int:
        kind = self._kind(c)
        if self.tail:  # an apostrophe that began a word, and what followed
            self.tail += c
            if self.tail in ENDINGS:
                word = Word(self.code)
                for x in self.tail:
                    n = word.grow(x)
                self.total, self.kind, self.tail = self.before + n, "E", ""
                return self.total
            if not any(e.startswith(self.tail) for e in ENDINGS):
                self.tail = ""
        if kind == self.kind and kind != "N":
            self.total = self.done + self.now.grow(c)
        else:
            before = self.total
            self._start(c, kind)
            if c == "'":
                self.tail, self.before = c, before
        return self.total

    def state(self) -> tuple:
        return self.done, self.now, len(self.now.letters), self.kind, self.tail, self.total, self.before

    def back(self, state: tuple) -> None:
        self.done, self.now, n, self.kind, self.tail, self.total, self.before = state
        self.now.cut(n)


def _unlike(a: str, b: str) -> int:
    """The place of the first difference."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _with_marks(code: Encoding, part: str) -> list[int]:
    """Tokens of the first 1, 2 ... characters of a part that isn't normal letter by letter."""
    run, out = Running(code), []
    safe, composed, states = 0, "", []  # where the last letter that later marks may join begins, its normal form so far, and the states before each place of that
    for i, c in enumerate(part):
        if i > safe and composed.endswith(part[i - 1]) and code.same_class[part[i - 1] + c]:  # it stays behind a mark of its class
            states.append(run.state())
            run.add(c)
            composed += c
            out.append(run.total)
            continue
        now = code.normal(part[safe : i + 1])
        if i and not code.is_mark[ord(c)] and now == composed + code.lowered[ord(c)]:
            now, safe, composed, states = now[len(composed) :], i, "", []
        same = _unlike(composed, now)
        if same < len(states):
            run.back(states[same])
            del states[same:]
        for x in now[same:]:
            states.append(run.state())
            run.add(x)
        composed = now
        out.append(run.total)
    return out


class Prefixes:
    """Tables of pieces that one worker has met, end to end in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.code = Encoding(path, self.library)
        self.special = [t["content"] for t in self.code.file["added_tokens"]]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes | list[int]:
        """Tokens of the first 1, 2 ... characters of a word."""
        if (table := self.words.get(word)) is None:
            table = list(map(Running(self.code).add, word)) if word in ENDINGS else self.code.every_prefix(word)
            if len(word) <= SHORT:
                if self.held > MEMORY // 2:
                    self.words, self.held = {}, 0
                table = self.words[word] = bytes(table)  # four bytes a character, so 192 at most
                self.held += 2 * len(word) + 190
        return table

    def _part(self, part: str) -> list[int]:
        if (low := self.code.lower(part)) is None:
            return _with_marks(self.code, part)
        out: list[int] = []
        for m in _WORD.finditer(low.translate(self.code.kinds)):
            table = self._word(low[m.start() : m.end()])
            out += [out[-1] + n for n in table] if out else table
        return out

    def _piece(self, piece: str) -> bytes | list[int]:
        """Tokens of the first 1, 2 ... characters of a piece."""
        if simple := self.code.simple.fullmatch(piece):
            word, signs = simple.groups()
            table = self._word(word.lower() if word.isascii() else word.translate(self.code.lowered))
            return [*table, *(table[-1] + n for n in self._word(signs))] if signs else table
        out: list[int] = []
        at = base = 0
        while at < len(piece):
            found = [(i, -len(s), s) for s in self.special if (i := piece.find(s, at)) >= 0]
            start, _, name = min(found) if found else (len(piece), 0, "")
            end = start + len(name)
            counts = self._part(piece[at : end - 1] if name else piece[at:])
            out += [base + n for n in counts] if base else counts
            if name:
                base += (counts[start - at - 1] if start > at else 0) + 1
                out.append(base)
            at = end
        return out

    @staticmethod
    def _room(new: list[str]) -> int:
        return 9 * sum(map(len, new)) + 150 * len(new)

    def _learn(self, new: list[str]) -> None:
        flat: list[int] = []
        for piece in new:
            flat += self._piece(piece)
        sizes = list(map(len, new))
        ends = np.cumsum(sizes) - 1
        long = [i for i, n in enumerate(sizes) if n > SHORT]
        if self._counts([new[i] for i in long]) != [flat[ends[i]] for i in long]:
            raise ValueError("the tokenizer does not count as its merges do")
        k = len(self.known)
        at = int(self.starts[k])
        while at + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(new) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[at : at + len(flat)] = flat
        self.starts[k + 1 : k + len(new) + 1] = at + ends + 1
        self.known.update(zip(new, range(k, k + len(new)), strict=True))
        self.used += self._room(new)

    def _found(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, the numbers of its pieces, all of them learned."""
        found = [pieces(t) for t in texts]
        every = set().union(*found)
        new = sorted(every.difference(self.known))  # words that begin alike follow each other
        if self.used + self._room(new) > MEMORY // 2:
            words, held = self.words, self.held
            self.clear()
            self.words, self.held = words, held
            new = sorted(every)
        if new:
            self._learn(new)
        return [np.fromiter(map(self.known.__getitem__, f), np.int64, len(f)) for f in found]

    def ends(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, the tokens up to the end of each piece."""
        return [np.cumsum(self.flat[self.starts[ids + 1] - 1], dtype=np.int32) for ids in self._found(texts)]

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, the tokens of its first 0, 1, 2 ... characters."""
        return [self._table(t, ids) for t, ids in zip(texts, self._found(texts), strict=True)]

    def _table(self, text: str, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int32)
        if not len(ids):
            return out
        start, size = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        first = np.cumsum(size) - size
        last = self.flat[start + size - 1]
        before = np.cumsum(last, dtype=np.int32) - last
        counts = self.flat[np.arange(size.sum()) + np.repeat(start - first, size)] + np.repeat(before, size)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.zeros(len(text) + 1, np.int64)
        word = 1 + np.flatnonzero(~_IS_SPACE[np.minimum(points, len(_IS_SPACE) - 1)])
        out[word], place[word] = counts, word
        return out[np.maximum.accumulate(place)]  # white space: as many as at the end of the piece before it


def prefixes(path: str) -> Prefixes:
    if path not in _workers:
        _workers[path] = Prefixes(path)
    return _workers[path]


def count_prefixes(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), every: bool = True) -> DataFrame:
    """The ``keep`` columns, n_bytes (UTF-8), n_tokens, and prefix_counts: tokens of the first 0, 1, 2 ... characters, a row for each row.

    Without ``every``, prefix_counts has the prefixes that end with a piece only, which is what budgets in whole words need.
    """
    fields = [f"_f{i}" for i in range(len(keep))]
    base = docs.select(*(F.col(k).alias(f) for k, f in zip(keep, fields, strict=True)), F.col(text).alias("_text"))

    def count(batches):
        for batch in batches:
            texts, lo = batch.column("_text").to_pylist(), 0
            while lo < len(texts):  # about a million characters at a time
                hi, size = lo + 1, len(texts[lo] or "")
                while hi < len(texts) and size + len(texts[hi] or "") < 1 << 20:
                    size += len(texts[hi] or "")
                    hi += 1
                known = prefixes(path)
                tables = (known.tables if every else known.ends)([t or "" for t in texts[lo:hi]])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in tables])]).astype(np.int32)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f) for f in fields), pa.array([len(t.encode()) if t else 0 for t in texts[lo:hi]], pa.int64()), pa.array([int(x[-1]) if len(x) else 0 for x in tables], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tables)))],
                    names=[*fields, "n_bytes", "n_tokens", "prefix_counts"],
                )
                lo = hi

    schema = "".join(f"{f} {base.schema[f].dataType.simpleString()}, " for f in fields)
    out = base.mapInArrow(count, f"{schema}n_bytes long, n_tokens long, prefix_counts array<int>")
    return out.select(*(F.col(f).alias(k) for k, f in zip(keep, fields, strict=True)), "n_bytes", "n_tokens", "prefix_counts")


def tokens_up_to(prefix_counts: Column | str, characters: Column | int) -> Column:
    """Tokens of the first ``characters`` characters of a text."""
    size = F.size(prefix_counts) - 1
    return F.get(prefix_counts, F.least(size, F.lit(characters) if isinstance(characters, int) else characters))


def fitting_characters(prefix_counts: Column | str, budget: int) -> Column:
    """The most characters that a text can be cut to so that it fits a budget of tokens."""
    places = F.transform(prefix_counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(places)
