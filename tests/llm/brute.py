"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SEP = r"[^\x20\x09-\x0D]+"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def words(t):
    return re.findall(SEP, t or "")


def substring_dedup(docs, k=35):
    where = Counter(tuple(w[i : i + k]) for _, t in docs for w in [words(t)] for i in range(len(w) - k + 1))
    out = []
    for d, t in docs:
        w = words(t)
        gone = {i + j for i in range(len(w) - k + 1) if where[tuple(w[i : i + k])] > 1 for j in range(k)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def token_counts(docs, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out = []
    for d, t in docs:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        out.append((d, len((t or "").encode()), n, n > 2048))
    return out


KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_pii(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(digits[::-1]))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return 9 <= len(digits) <= 15 if kind == "phone" else True

    found = [(m.start(), i, m.end()) for i, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(KINDS[i], m[0])]
    return sorted(found)


def pii(docs):
    out = []
    for d, t in docs:
        s = base_pii(t)
        out.append((d, *(sum(x[1] == i for x in s) for i in range(4)), sha(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s))))
    return out


def contexts(texts, support, rounds, confident):
    """(text, start, end) of the spans that contexts add."""
    between, gap, edge = "[\\s\"'()\\[\\]{}<>,.;:=!?&$%#*|]+", "\\s\"'()\\[\\]{}<>,;:=|", "\"'()[]{}<>,.;:=!?&$%#*|"
    split = lambda t: [w for w in re.split(between, t.lower()) if w]
    edges, seeds, places, total = Counter(), set(), [], Counter()
    for t in texts:
        w = split(t)
        total.update(zip(w, w[1:], strict=False))
        base = base_pii(t)
        runs = [(m.start(), m.end()) for m in re.finditer(f"[^{gap}]+", t) if re.search("[0-9@]", m[0])]
        mentions = [(a, b, True, next(x for x in reversed(runs) if x[0] <= a)[0]) for a, _, b in base]
        for x, y in runs:
            a, b = x + len(t[x:y]) - len(t[x:y].lstrip(edge)), y - len(t[x:y]) + len(t[x:y].rstrip(edge))
            m = t[a:b]
            if len(m) >= 6 and ("@" in m or sum(c.isdigit() for c in m) >= 3) and not any(s < b and a < e or a <= s < y and s >= x for s, _, e in base):
                mentions.append((a, b, False, x))
        for a, b, seed, x in mentions:
            before = tuple(split(t[:x])[-2:])
            if len(before) == 2:
                edges[before, t[a:b].lower()] += 1
                if seed:
                    seeds.add((before, t[a:b].lower()))
                else:
                    places.append((t, a, b, before))
    instances = defaultdict(set)
    for p, i in edges:
        instances[p].add(i)
    edges = {(p, i): n for (p, i), n in edges.items() if len(instances[p]) >= support}
    score = {i: 0.0 for _, i in edges} | {i: 1.0 for p, i in seeds if (p, i) in edges}
    best = {}
    for _ in range(rounds):
        best = {}
        for p in {p for p, _ in edges}:
            weight = sum(n * score[i] for (q, i), n in edges.items() if q == p) / max(total[p], 1)
            if weight >= confident and sum(score[i] > 0 for q, i in edges if q == p) >= support:
                best[p] = min(1.0, weight)
        score = {i: max([s, *(best[p] for p, j in edges if j == i and p in best)]) for i, s in score.items()}
    return {(t, a, b) for t, a, b, p in places if p in best}


def contamination(docs, items, k=13):
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = lambda t: re.findall(pat, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = defaultdict(set)
    for i, t in items:
        w = lower(t)
        if w:
            for j in range(max(1, len(w) - k + 1)):
                grams[tuple(w[j : j + k])].add(i)
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w, hit, got = lower(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in grams:
                    hit |= set(range(j, j + n))
                    got |= grams[g]
        got = sorted({str(i) for i in got if i is not None})
        out.append((d, len(w), len(hit), len(got), sha(",".join(got)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def quality(docs):
    out = []
    for d, t in docs:
        w, t = words(t), t or ""
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = len({i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)})
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        out.append((d, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, rep, len(w) < 10 or 100 * rep > 20 * len(w)))
    return out


def simhash(docs):
    import xxhash

    prints = []
    for d, t in docs:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        prints.append((d, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    first = {}
    for d, f in prints:
        if d is not None:
            first[find(f)] = min(d, first.get(find(f), d))
    return [(d, f"{f:016x}", first.get(find(f))) for d, f in prints]


def bit_components(fps, radius=2):
    """fingerprint -> the smallest fingerprint that steps of ``radius`` bits at most reach, by breadth-first search over all pairs."""
    import numpy as np

    left, out = set(fps), {}
    for f in sorted(fps):
        if f not in left:
            continue
        left.discard(f)
        todo, out[f] = [f], f
        while todo and left:
            x = todo.pop()
            rest = np.array(list(left), np.uint64)
            for y in rest[np.bitwise_count(rest ^ np.uint64(x)) <= radius].tolist():
                left.discard(y)
                out[y] = f
                todo.append(y)
    return out


def targets(sizes: dict, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in left))
        over = [s for s in left if level * weight[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in left}
        fixed |= {s: float(cap * sizes[s]) for s in over}
