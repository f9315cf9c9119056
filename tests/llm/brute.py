"""Plain Python versions of the operators, for comparison in tests."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near_duplicates(rows, ngram=5, num=85, den=100):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component)}"""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + ngram]) for k in range(max(1, len(w) - ngram + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in index[s])
        for j, c in common.items():
            if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def remove_repeats(rows, window=35):
    """rows: (doc_id, text) -> {doc_id: (n_words, n_removed, kept text)}"""
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen = Counter(tuple(w[k:k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        left = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(left), " ".join(left))
    return out


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text):
    """{kind: [(start, end)]}"""
    out = {}
    for kind, pattern in PII.items():
        out[kind] = []
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out[kind].append((m.start(), m.end()))
    return out
