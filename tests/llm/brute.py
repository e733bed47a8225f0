"""Brute-force versions of operators, in plain Python."""

import collections
import itertools

import numpy as np


def tokens(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = tokens(text)
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def grouped(links, nodes):
    """Each node's least reachable node."""
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(rows):
    """Components of rows (doc_id, text, ..) by all pairs."""
    known = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(known, 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return grouped(links, {i for i, _ in known})


def normal(line):
    """Words of letters and digits of a line, A-Z lower-cased and digits 0; without such words the line's own ink in marks."""
    kept = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else "0" if "0" <= c <= "9" else " " for c in line)
    kept = " ".join(w for w in kept.split(" ") if w)
    return kept or "\0" + line.strip(" \t\n\r\v\f")


def levenshtein(a, b):
    b = np.array([ord(c) for c in b])
    place = np.arange(len(b) + 1)
    row = place.copy()
    for i, c in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (b != ord(c)))
        row = np.minimum.accumulate(np.append(i, step) - place) + place
    return int(row[-1])


def alike(a, b):
    """Edit similarity of 0.9 or more of two normalised lines."""
    most = max(len(a), len(b))
    return a[:1] != "\0" and b[:1] != "\0" and 10 * abs(len(a) - len(b)) <= most and 10 * levenshtein(a, b) <= most


def deduped_lines(rows):
    """Of rows (doc_id, text, ..) the (text, number of lines lost), by all pairs of distinct normalised lines."""
    occurs = collections.defaultdict(set)
    for i, t, *_ in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\v\f"):
                occurs[normal(line)].add(((-1 if i is None else i), t, n))
    links = [(a, b) for a, b in itertools.combinations(occurs, 2) if alike(a, b)]
    groups, drop = collections.defaultdict(set), collections.defaultdict(set)
    for line, root in grouped(links, occurs).items():
        groups[root] |= occurs[line]
    for g in groups.values():
        first = min(g, key=lambda o: (o[0], o[2]))
        for o in g - {first}:
            drop[o[:2]].add(o[2])
    out = []
    for i, t, *_ in rows:
        gone = drop[(-1 if i is None else i), t]
        out.append((t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone), len(gone)))
    return out, len(links)
