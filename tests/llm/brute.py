"""Plain Python versions of the operators, for small tables."""

import re
from collections import defaultdict

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def linked(sets, similar):
    """(links, least id reachable) of every id, by a test of all pairs that share an element."""
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = defaultdict(set)
    for a, b in pairs:
        if similar(sets[a], sets[b]):
            links[a].add(b)
            links[b].add(a)
    return components(list(sets), links)


def components(ids, links):
    root = {}
    for i in sorted(ids):
        if i in root:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {i: (len(links[i]), root[i]) for i in ids}


def jaccard(a, b):
    n = len(a & b)
    return 5 * n >= 4 * (len(a) + len(b) - n)


def contaminated(docs, items):
    """(words, hit words, sorted item ids as strings) of every document."""
    windows = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    out = []
    for text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, g in set(windows):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def jump(key, shards):
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b
