"""Plain Python versions of the corpus operators, for small tables."""

import collections
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(nodes, linked):
    """Smallest member of each node's component, from all pairs."""
    nodes = sorted(nodes)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def similar(a, b, percent=75):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def word_shingles(text):
    words = WORDS.findall((text or "").translate(A_Z))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def near(docs):
    """{id: (n_shingles, component)} of (id, text) rows."""
    sets = {i: word_shingles(t) for i, t in docs}
    found = groups(sets, lambda a, b: similar(sets[a], sets[b]))
    return {i: (len(sets[i]), found[i]) for i in sets}


SHINGLE = re.compile(r"(?=(.{16}))(?:\S{1,24}+(?: |\Z)|\S) ?", re.S)


def lines_left(docs):
    """{id: text without repeated lines} of (id, text) rows."""
    places, sets = collections.defaultdict(list), {}
    for i, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            normal = re.sub(r"\s+", " ", line).strip().lower()
            if len(normal) >= 16:
                places[normal].append((i, at))
                sets[normal] = set(SHINGLE.findall(normal))
    found = groups(places, lambda a, b: similar(sets[a], sets[b]))
    first, gone = {}, set()
    for normal, component in found.items():
        first[component] = min([first.get(component, (float("inf"), 0)), *places[normal]])
    for normal, component in found.items():
        gone.update(p for p in places[normal] if p != first[component])
    return {i: "\n".join(x for at, x in enumerate((t or "").split("\n")) if (i, at) not in gone) for i, t in docs}


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leaks(docs, items):
    """{(doc, item)} with a run of matching tokens, over all alignments."""
    found = set()
    for d, text in docs:
        words = tokens(text)
        for i, item_text in items:
            item = tokens(item_text)
            if len(item) < 5:
                continue
            for offset in range(-len(item) + 1, len(words)):
                run = hits = top = best = 0
                for q, token in enumerate(item):
                    same = 0 <= offset + q < len(words) and words[offset + q] == token
                    score = run + (1 if same else -2)
                    hits = hits + same if score > 0 else 0
                    if score > top:
                        top, best = score, hits
                    run = max(0, score)
                if best >= min(13, -(-3 * len(item) // 4)):
                    found.add((d, i))
                    break
    return found
