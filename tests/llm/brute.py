"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WS = "\t\n\x0b\x0c\r "
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near(docs, percent=85):
    """doc_id -> (n_shingles, component), for distinct doc ids."""
    sets = {}
    for i, text in docs:
        w = words((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(docs, window=35):
    """List of (n_words, n_removed, kept sha), one for each row."""
    rows = [words(t) for _, t in docs]
    seen = Counter(tuple(w[k : k + window]) for w in rows for k in range(len(w) - window + 1))
    out = []
    for w in rows:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def lines(docs, min_chars=40, min_docs=5):
    """List of (n_lines, n_dropped, text), one for each row; null ids sort first."""
    key = lambda x: x.strip(WS).translate(LOWER)
    own = lambda i: -(2**63) if i is None else i
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(own(i))
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == own(i)]
        out.append((len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def exact(docs):
    """doc_id -> (keep_id, size), for distinct ids."""
    groups = defaultdict(list)
    for i, t in docs:
        groups["".join(c for c in (t or "") if c not in WS)].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
