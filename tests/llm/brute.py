"""Plain restatements of the contracts, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def covered(rows, size, units, strict):
    """Positions under windows that start earlier; rows are (id, sequence) in order. With ``strict``
    only smaller ids are earlier, otherwise also earlier starts."""
    first = {}
    for n, (key, seq) in enumerate(rows):
        for i in range(len(seq) - size + 1):
            window = tuple(seq[i : i + size]) if units else seq[i : i + size]
            at = (key,) if strict else (n, i)
            first[window] = min(first.get(window, at), at)
    out = []
    for n, (key, seq) in enumerate(rows):
        gone = set()
        for i in range(len(seq) - size + 1):
            window = tuple(seq[i : i + size]) if units else seq[i : i + size]
            if first[window] < ((key,) if strict else (n, i)):
                gone.update(range(i, i + size))
        out.append(gone)
    return out


def spans(gone):
    return sum(1 for i in gone if i - 1 not in gone)


def shingles(text, n=5):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, percent=80):
    """(id, size of set, component) of rows with distinct ids."""
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((k, len(s), root(k)) for k, s in sets.items())
