"""Brute-force near-duplicate components."""


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j:j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            s, t = sets[a], sets[b]
            if s and t and 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)):
                both = len(s & t)
                if both * 100 >= (len(s) + len(t) - both) * percent:
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}
