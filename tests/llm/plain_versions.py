"""Plain versions of operators, without Spark, numpy or hashes, that tests compare with."""

import collections
import hashlib
import re

LOW = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def jaccard_groups(texts, ids):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    low = {i: i for i in ids}
    find = lambda i: i if low[i] == i else find(low[i])
    for a in range(len(ids)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 90 * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                low[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def line_removals(docs):
    """The numbers of the lines that each document (id, text) loses: all but the first of each component of similar lines."""
    squeeze = lambda x: re.sub(r"[\x20\x09-\x0D]", "", x.translate(LOW))
    found, where = {}, []
    for i, t in sorted(docs, key=lambda d: d[0]):
        for k, line in enumerate((t or "").split("\n")):
            if q := squeeze(line):
                where.append((i, k, q))
                found.setdefault(q, {q[j : j + 8] for j in range(len(q) - 7)})
    low = {q: q for q in found}

    def find(q):
        while low[q] != q:
            q = low[q]
        return q

    holders = collections.defaultdict(list)
    for q in found:
        for other, n in collections.Counter(o for s in found[q] for o in holders[s]).items():
            if 10 * n >= 8 * len(found[q] | found[other]) and find(q) != find(other):
                low[find(q)] = find(other)
        for s in found[q]:
            holders[s].append(q)
    first, gone = {}, collections.defaultdict(list)
    for i, k, q in where:
        if first.setdefault(find(q), (i, k)) != (i, k):
            gone[i].append(k)
    return gone


def contaminated(text, items):
    """n_words, n_hit, items_sha256 and contaminated of a text by items (id, text)."""
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    w, hit, found = word(text), set(), set()
    windows = collections.defaultdict(list)
    for k in {min(13, len(word(t))) for _, t in items} - {0}:
        for b in range(len(w) - k + 1):
            windows[tuple(w[b : b + k])].append(b)
    for i, t in items:
        iw = word(t)
        k = min(13, len(iw))
        for a in range(len(iw) - k + 1) if k else ():
            for b in windows.get(tuple(iw[a : a + k]), ()):
                hit |= set(range(b, b + k))
                found.add(str(i))
    return len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)
