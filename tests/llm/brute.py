"""Plain definitions of the results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def decontaminate(docs, items, n=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(_AZ))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1) if size else ():
            windows[tuple(w[k : k + size])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, its = cut(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    its |= windows[tuple(w[k : k + size])]
        out.append((d, len(w), len(hit), sorted(its)))
    return out


def text_stats(text):
    w = words(text)
    c, cov = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            cov.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cov)


def suffix_dedup(docs, length=400):
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = set()
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        runs = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(b), len(gone), runs, sha(bytes(x for i, x in enumerate(b) if i not in gone))))
    return out


def shingle_set(text):
    w = words((text or "").translate(_AZ))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_dedup(docs, percent=85):
    sets = [(d, shingle_set(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y, key=lambda k: sets[k][0])] = min(x, y, key=lambda k: sets[k][0])
    return [(d, len(s), sets[find(i)][0]) for i, (d, s) in enumerate(sets)]


def line_dedup(docs):
    seen, gone = set(), defaultdict(set)
    for d, t in sorted(docs, key=lambda x: x[0]):
        lines = (t or "").split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone[d].update(range(i, i + 3))
                seen.add(w)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        out.append((d, 0 if t is None else len(lines), len(gone[d]), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone[d])))
    return out
