"""Plain versions of the definitions, for brute-force comparisons."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(rows):
    """rows: (doc_id, text); the smallest id reachable by links of at least 75 %, by index."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * shared >= 75 * (len(s) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def repeat_words(w):
    count, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    return len(covered)


def dup_lines(text):
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            n += line in seen
            seen.add(line)
    return n
