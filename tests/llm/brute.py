"""Slow, plain versions of the operators, straight from their definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def shingle_sets(docs):
    out = {}
    for i, text in docs:
        w = words((text or "").translate(FOLD))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def jaccard_components(docs):
    sets = shingle_sets(docs)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            index[g].add(i)
    for i, s in sets.items():
        near = Counter(j for g in s for j in index[g] if j < i)
        for j, both in near.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def line_dedup(docs):
    key = lambda line: line.strip(WS).translate(FOLD)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def substring_dedup(docs, size=50):
    first = {}
    for i, text in docs:
        w = words(text)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = {k + d for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for d in range(size)}
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())


def base_spans(text):
    """(start, kind number, kind, end) of the strict patterns, by start and kind."""
    found = []
    for at, (kind, pattern) in enumerate(PRIVATE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            right = {
                "email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]
            if right():
                found.append((m.start(), at, kind, m.end()))
    return sorted(found)


PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    double = lambda x: x - 9 if x > 9 else x
    return sum(double(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(digits))) % 10 == 0


def periodic_runs(x, least=24, exponent=3):
    """(start, length, period) of all runs in a list of words."""
    found = []
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                if not any(all(x[k] == x[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                    found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(x, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(x) if k not in gone)


def with_period(doc_id, x):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(x)
    if h % 10 or not n:
        return x
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]


def divergence(docs, min_docs=10, top=10):
    """Rows (lang, source, part, item, value, rank) from (text, lang, source)."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    rows = [(term.findall((t or "").translate(FOLD)), a or "", b or "") for t, a, b in docs]
    out = []
    for lang in {r[1] for r in rows}:
        held = Counter(w for ws, a, _ in rows if a == lang for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= min_docs)
        sources = sorted({b for _, a, b in rows if a == lang})
        counts = {b: Counter(w for ws, a, c in rows if (a, c) == (lang, b) for w in ws if held[w] >= min_docs) for b in sources}
        whole = sum(counts.values(), Counter())
        share = lambda c, w, v=len(kept): 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * v)
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(gap(share(counts[s], w), share(counts[o], w)) for w in kept), o) for o in sources if o != s]
            terms = [(gap(share(counts[s], w), share(whole, w)), w) for w in kept if counts[s][w] and share(counts[s], w) > share(whole, w)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)
