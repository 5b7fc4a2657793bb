"""Plain versions of the training-data operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring_dedup(docs, width=13):
    """{row: (n_words, n_removed, sha256)} of (id, text) rows."""
    first = {}
    lists = [(i, words(t)) for i, t in docs]
    for i, w in lists:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def suffix_dedup(docs, width=100):
    """(id, n_bytes, n_removed, n_spans, kept bytes) of (id, text) rows with distinct ids."""
    seen, out = set(), []
    for i, t in sorted(docs):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - width + 1):
            s = x[k : k + width]
            if s in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(s)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return out


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_groups(docs, similarity=0.8, n=5):
    """{id: (smallest id of the group, number of links)} of (id, text) rows."""
    sets = {i: grams(t, n) for i, t in docs}
    parent = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    post = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for g in sets[i] for j in post[g])
        for g in sets[i]:
            post[g].append(i)
        for j, k in shared.items():
            if k / (len(sets[i]) + len(sets[j]) - k) >= similarity:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in sets}


def tokens(text):
    return [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]


def contaminated(text, items, window=13, identity=0.8):
    """Whether some stretch of an item agrees with the text, at any shift."""
    d = tokens(text)
    for item in items:
        b = tokens(item)
        width = min(len(b), window)
        for shift in range(-len(b) + 1, len(d)):
            agree = [0 <= shift + j < len(d) and d[shift + j] == b[j] for j in range(len(b))]
            if width and max(sum(agree[s : s + width]) for s in range(len(b) - width + 1)) >= width * identity:
                return True
    return False
