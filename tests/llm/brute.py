"""Plain versions of the text operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(docs, k, num, den):
    sets = {d: shingle_set(t, k) for d, t in docs}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    by = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            by[s].append(d)
    shared = defaultdict(int)
    classes = defaultdict(list)
    for d, s in sets.items():
        if s:
            classes[frozenset(s)].append(d)
    one = {d: min(c) for c in classes.values() for d in c}
    for c in classes.values():
        for d in c:
            a, b = find(d), find(min(c))
            top[max(a, b)] = min(a, b)
    for ds in by.values():
        reps = sorted({one[d] for d in ds})
        for i, a in enumerate(reps):
            for b in reps[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeats(docs, width=50):
    words = {d: WORD.findall(t or "") for d, t in docs}
    first, out = {}, {}
    for d in sorted(words):
        w = words[d]
        gone = [False] * len(w)
        own = []
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if first.get(key, d) < d:
                gone[i : i + width] = [True] * width
            own.append(key)
        for key in own:
            first.setdefault(key, d)
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def leaks(docs, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        m = min(width, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[a : a + m])].add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if (key := tuple(w[a : a + m])) in windows:
                    hit.update(range(a, a + m))
                    ids |= windows[key]
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))
    return out


def top_k(vectors, queries, k=5):
    import math

    v = {i: [math.floor(256 * float(x)) for x in e] for i, e in vectors if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in sorted(v):
        if queries(q):
            scored = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return out


def held(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts
