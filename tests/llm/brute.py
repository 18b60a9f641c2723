"""Plain versions of what the operators of this subpackage compute, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def held(doc_id, every):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % every == 0


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def line_cut(docs):
    strip, holders = " \t\n\x0b\x0c\r", defaultdict(set)
    key = lambda x: x.strip(strip).translate(LOWER)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        gone = [i is not None and len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i for x in ls]
        kept = "\n".join(x for x, g in zip(ls, gone, strict=True) if not g)
        out.append((i, len(ls), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def leaks(docs, items, size=10):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            if item is not None:
                windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    names |= own
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def near_copies(docs, similar=0.8):
    """doc_id -> (class id, links) by comparing all pairs that share a gram."""
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    shared = Counter((a, b) for ids in where.values() for x, a in enumerate(ids) for b in ids[x + 1 :])
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n >= similar * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def targets(sizes, weights=(5, 2, 1), cap=3):
    """source -> target from source -> size, by sharing what capped sources leave until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > cap * sizes[s]]
        if not over:
            return fixed | {s: rest * w[s] / total for s in free}
        fixed |= {s: cap * sizes[s] for s in over}
