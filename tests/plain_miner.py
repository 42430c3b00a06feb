"""A mining run as loops over lines, written from the survey's description alone: no SQL, no arrays of Spark."""

import re
from collections import defaultdict


class Plain:
    def __init__(self, lines, support=None, rsupport=None, separator="[ ]+", byteoffset=0, lfilter=None, template=None, wfilter=None, wsearch=None, wreplace=None, aggrsup=False, wweight=0.0, weightf=1, outputmode=0, detailtoken=False):
        self.s = support if support is not None else int(len(lines) * rsupport / 100)
        self.rewrite = (re.compile(wfilter), re.compile(wsearch), wreplace) if wfilter else None
        split = [self.split(x, separator, byteoffset, lfilter, template) for x in lines]
        count = defaultdict(int)
        for ws in split:
            for w in {w for w in ws if w} | {v for w in ws if w and (v := self.new(w)) is not None}:
                count[w] += 1
        self.words = dict(count)
        self.frequent = {w for w, n in count.items() if n >= self.s}
        self.candidates = {}  # constants -> [support, gaps low, gaps high, first line]
        pairs = defaultdict(int)
        for i, ws in enumerate(split):
            key, gaps = self.key(ws, self.rewrite is not None)
            if not key:
                continue
            for a in set(key):
                for b in set(key):
                    pairs[a, b] += 1
            if key not in self.candidates:
                self.candidates[key] = [1, gaps, gaps, i]
            else:
                c = self.candidates[key]
                self.candidates[key] = [c[0] + 1, [min(x) for x in zip(c[1], gaps, strict=True)], [max(x) for x in zip(c[2], gaps, strict=True)], c[3]]
        support = {k: c[0] for k, c in self.candidates.items()}
        if aggrsup:
            for p in self.candidates:
                if any(self.candidates[p][2]):
                    support[p] += sum(self.candidates[q][0] for q in self.candidates if q != p and self.covers(p, q))
        self.support = support
        self.clusters = {k for k, n in support.items() if n >= self.s}
        self.outliers = [i for i, ws in enumerate(split) if self.frequent and self.key(ws, False)[0] not in self.clusters]
        self.weights = {k: [self.weight(k, w, pairs, weightf) for w in k] for k in self.clusters} if wweight else {}
        shown = self.joined(wweight, detailtoken) if wweight else [(self.pattern(k, *self.candidates[k][1:3]), support[k], len(k), False, self.candidates[k][3]) for k in self.clusters]
        order = (lambda r: (r[2], r[3], -r[4], r[0])) if outputmode else (lambda r: (-r[1], r[2], -r[4], r[0]))
        self.report = [(r[0], r[1]) for r in sorted(shown, key=order)]

    @staticmethod
    def split(line, separator, offset, lfilter, template):
        line = line.encode()[offset:].decode() if offset else line
        if not line:
            return []
        if lfilter is not None:
            m = re.search(lfilter, line)
            if not m:
                return []
            if template is not None:
                line = re.sub(r"\$(\d*)", lambda t: line if int(t[1] or 0) == 0 else m[int(t[1])] or "", template)
                if not line:
                    return []
        words, at = [], 0
        while at < len(line):
            m = re.compile(separator).search(line, at)
            words.append(line[at : m.start() if m else len(line)])
            at = m.end() if m else len(line)
        return words

    def new(self, word):
        if not self.rewrite or not (self.rewrite[0].search(word) and self.rewrite[1].search(word)):
            return None
        done = False
        while m := self.rewrite[1].search(word):
            if done and self.rewrite[2].startswith(m[0]):
                break
            word, done = word[: m.start()] + self.rewrite[2] + word[m.end() :], True
        return word

    def key(self, ws, rewrite):
        key, gaps, gap = [], [], 0
        for w in ws:
            found = w if w in self.frequent else None
            if found is None and rewrite and w and self.new(w) in self.frequent:
                found = self.new(w)
            if not found:
                gap += 1
                continue
            key.append(found)
            gaps.append(gap)
            gap = 0
        return tuple(key), [*gaps, gap]

    def covers(self, p, q):
        lo, hi = self.candidates[p][1:3]
        path = []
        for i, w in enumerate(q):
            if self.candidates[q][2][i]:
                path.append((None, self.candidates[q][1][i], self.candidates[q][2][i]))
            path.append((w, 1, 1))
        if self.candidates[q][2][len(q)]:
            path.append((None, self.candidates[q][1][len(q)], self.candidates[q][2][len(q)]))
        c = a = b = 0
        for w, x, y in path:
            a, b = a + x, b + y
            if c == len(p) or a - 1 < lo[c]:
                continue
            if b - 1 > hi[c]:
                return False
            if w == p[c]:
                c, a, b = c + 1, 0, 0
        return c == len(p) and lo[c] <= a and b <= hi[c]

    @staticmethod
    def weight(key, word, pairs, function):
        dep = lambda a: pairs[a, word] / pairs[a, a]
        if function == 1:
            return sum(dep(a) for a in key) / len(key)
        others = set(key)
        return 1.0 if len(others) == 1 else (sum(dep(a) for a in others) - 1) / (len(others) - 1)

    @staticmethod
    def pattern(words, lo, hi):
        out = ""
        for i, w in enumerate(words):
            out += (f"*{{{lo[i]},{hi[i]}}} " if hi[i] else "") + w + " "
        return out + (f"*{{{lo[-1]},{hi[-1]}}}" if hi[-1] else "")

    def joined(self, threshold, detail):
        groups = defaultdict(list)
        for k in self.clusters:
            groups[tuple(w if x >= threshold else None for w, x in zip(k, self.weights[k], strict=True))].append(k)
        out = []
        for mask, members in groups.items():
            tokens = [sorted({k[i] for k in members}) for i in range(len(mask))]
            words = ["(" + "|".join(t) + ")" if len(t) > 1 or (detail and m is None) else t[0] for t, m in zip(tokens, mask, strict=True)]
            lo = [min(x) for x in zip(*(self.candidates[k][1] for k in members), strict=True)]
            hi = [max(x) for x in zip(*(self.candidates[k][2] for k in members), strict=True)]
            out.append((self.pattern(words, lo, hi), sum(self.support[k] for k in members), len(mask), None in mask, min(self.candidates[k][3] for k in members)))
        return out
