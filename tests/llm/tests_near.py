"""Brute-force versions of the near-duplicate operators, shared by the tests."""

import itertools
import re

import xxhash

from hushframe.llm import substring


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def least(ids, links):
    r = roots(len(ids), links)
    first = {}
    for i, x in zip(ids, r, strict=True):
        first[x] = min(i, first.get(x, i))
    return [first[x] for x in r]


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "").encode())
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def paragraphs(text, least=substring.MIN_WORDS):
    """Word spans of long lines and of runs of short ones."""
    at, spans, run = 0, [], []
    for line in [*re.split("\n", text), ""]:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        if 0 < n < least:
            run.append((at, at + n))
        else:
            if run and run[-1][1] - run[0][0] >= least:
                spans.append((run[0][0], run[-1][1]))
            if n:
                spans.append((at, at + n))
            run = []
        at += n
    return spans


def near_classes(texts):
    """{id: least id of its class} over all pairs of fingerprints."""
    ids = sorted(texts)
    fp = [plain_fingerprint(texts[i]) for i in ids]
    links = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4]
    return dict(zip(ids, least(ids, links), strict=True))


def paragraph_losers(texts):
    """{id: word spans of paragraphs that are near an earlier one}, by exact similarity of all pairs that share a shingle."""
    lines, ends = {}, {}
    for i, text in texts.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
        for a, b in paragraphs(text):
            lines[i, a] = frozenset(tuple(ws[k : k + 5]) for k in range(a, max(a + 1, b - 4)))
            ends[i, a] = b
    places = sorted(lines)
    by = {}
    for n, p in enumerate(places):
        for s in lines[p]:
            by.setdefault(s, []).append(n)
    pairs = {(i, j) for m in by.values() for i, j in itertools.combinations(m, 2)}
    links = [(i, j) for i, j in pairs if len(lines[places[i]] & lines[places[j]]) >= 0.8 * len(lines[places[i]] | lines[places[j]])]
    out = {}
    for p, f in zip(places, least(places, links), strict=True):
        if p != f:
            out.setdefault(p[0], []).append((p[1], ends[p]))
    return out
