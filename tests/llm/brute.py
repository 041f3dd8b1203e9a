"""Plain Python versions of the operators' contracts."""

import math
import re
from collections import defaultdict

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self, ids):
        self.p = {i: i for i in ids}

    def find(self, x):
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def grams(text, n=4):
    w = re.findall(WORD, (text or "").translate(LOWER))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def ngram_join(docs, n=4, percent=85):
    sets = {i: grams(t, n) for i, t in docs}
    inv = defaultdict(list)
    for i in sorted(sets):
        for g in sets[i]:
            inv[g].append(i)
    u = Union(sets)
    for i in sets:
        shared = defaultdict(int)
        for g in sets[i]:
            for j in inv[g]:
                shared[j] += j > i
        for j, k in shared.items():
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                u.join(i, j)
    return {i: (len(sets[i]), u.find(i)) for i in sets}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    text = text or ""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for rank, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def embeddings(rows, threshold=0.93):
    """[(vec_id, vector, label)] -> sorted (vec_id, links, component, kept)."""
    groups = defaultdict(list)
    for i, (_, v, label) in enumerate(rows):
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        groups[label, len(v)].append(i)
    n, u = np.zeros(len(rows), int), Union(range(len(rows)))
    for at in groups.values():
        m = np.array([rows[i][1] for i in at], float)
        m /= np.linalg.norm(m / np.abs(m).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(m).max(axis=1, keepdims=True)
        s = m @ m.T >= threshold
        np.fill_diagonal(s, False)
        n[at] = s.sum(axis=1)
        for a, b in zip(*np.nonzero(s), strict=True):
            u.join(at[a], at[b])
    least = {}
    for i, r in enumerate(rows):
        least[u.find(i)] = min(least.get(u.find(i), r[0]), r[0])
    return sorted((r[0], int(n[i]), least[u.find(i)], r[0] == least[u.find(i)]) for i, r in enumerate(rows))
