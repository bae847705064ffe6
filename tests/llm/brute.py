"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

NO_ID = (1 << 63) - 1
SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def words_of(text, lower=True):
    raw = (text or "").encode()
    if lower:
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)
    return [x for x in SPACE.split(raw) if x]


def near(rows, k, percent):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(zip(*[w[i:] for i in range(k)])))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    up[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in members[find(i)] if x is not None]
        c = min(ids) if ids else d
        out.append((d, len(sets[i]), c, d == c))
    return out


def repeats(rows, need=50):
    """Kept bytes, bytes removed and spans of each row, in the order given."""
    data = [(NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in sorted(data, key=lambda x: x[0]):
        for i in range(len(b) - need + 1):
            first.setdefault(b[i : i + need], d)
    out = []
    for d, b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - need + 1):
            if first[b[i : i + need]] < d:
                mask[i : i + need] = b"\x01" * need
        spans = sum(1 for i in range(len(mask)) if mask[i] and not (i and mask[i - 1]))
        out.append((bytes(x for x, m in zip(b, mask) if not m), sum(mask), spans))
    return out


def rules(rows, most=20, share=0.002, loss=0.5):
    """(kept, cleaned text) of rows (doc_id, host, text)."""
    held, contents, first = defaultdict(set), defaultdict(set), {}

    def lines(t):
        return [(x, b" ".join(words_of(x))) for x in (t or "").split("\n")]

    for d, h, t in rows:
        contents[h].add(t or "")
        for _, key in lines(t):
            if key:
                held[h, key].add(t or "")
                first[h, key] = min(first.get((h, key), NO_ID), NO_ID if d is None else d)
    out = []
    for d, h, t in rows:
        w = words_of(t, False)
        windows = list(zip(w, w[1:], w[2:]))
        c = Counter(windows)
        hit = {i + j for i, x in enumerate(windows) if c[x] > 1 for j in range(3)}
        gone = [x for x, key in lines(t) if key and len(held[h, key]) > most and len(held[h, key]) > share * len(contents[h]) and (NO_ID if d is None else d) > first[h, key]]
        removed = sum(len(words_of(x)) for x in gone)
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        left = [x for x in (t or "").split("\n") if x not in gone]
        out.append((not failed and removed <= loss * len(w), "\n".join(left)))
    return out


def held_items(rows, items):
    """doc_ids of the rows that hold an item word for word."""
    norm = lambda s: " " + " ".join(re.findall(r"\w+", (s or "").lower())) + " "
    wanted = [norm(t) for t in items if t]
    return {d for d, t in rows if any(w in norm(t) for w in wanted)}


def sha(b):
    return hashlib.sha256(b).hexdigest()
