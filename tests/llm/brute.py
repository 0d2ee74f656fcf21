"""Brute-force versions that several tests share."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def strip(rows, match=100):
    """Kept bytes and removed spans of (doc_id, text) rows with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - match + 1):
            s = b[p:p + match]
            if s in seen:
                gone[p:p + match] = [True] * match
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def classes(rows, least=0.8):
    sets = {i: Counter(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if (w := WORD.findall(t or "")) else Counter()
            for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    text = dict(rows)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            p, q = sets[a], sets[b]
            if text[a] is not None and text[a] == text[b]:
                near = True
            elif not p or not q:
                near = False
            else:
                tp, tq = sum(p.values()), sum(q.values())
                near = sum(1 / sum(max(p[y] / tp / (p[s] / tp), q[y] / tq / (q[s] / tq)) for y in p | q)
                           for s in p if s in q) >= least - 1e-12
            if near:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}
