"""Brute-force components of texts by the Jaccard likeness of five-word shingles, for tests."""


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    low = list(range(len(rows)))

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b) > 0):
                low[top(i)] = top(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(k)
    best = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [best[top(i)] for i in range(len(rows))]
