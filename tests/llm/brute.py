"""Plain versions of operators, for comparison."""

import re


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    names = {}
    for i, (key, _) in enumerate(rows):
        names[root(i)] = min(names.get(root(i), key), key)
    return sorted((key, len(sets[i]), names[root(i)]) for i, (key, _) in enumerate(rows))
