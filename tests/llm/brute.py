"""Plain versions of the operators, for small fixtures."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORD.findall(raw)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard(docs):
    """{doc_id: (n_shingles, component)} of {doc_id: text}."""
    s = {i: shingles(t) for i, t in docs.items()}
    ids = sorted(s)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    c = components(ids, links)
    return {i: (len(s[i]), c[i]) for i in ids}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_dedup(docs, tau=2, least=24):
    """{doc_id: (kept text, removed line numbers)} of {doc_id: text}."""
    lines = [(i, n, x) for i, t in sorted(docs.items()) if t is not None for n, x in enumerate(t.split("\n"))]
    gone, seen, short = set(), [], set()
    for i, n, x in lines:
        raw = x.encode()
        if len(raw) < least:
            if raw and raw in short:
                gone.add((i, n))
            short.add(raw)
            continue
        if any(abs(len(raw) - len(y)) <= tau and distance(raw, y) <= tau for y in seen):
            gone.add((i, n))
        seen.append(raw)
    out = {}
    for i, t in docs.items():
        if t is None:
            out[i] = (None, [])
        else:
            parts = t.split("\n")
            out[i] = ("\n".join(x for n, x in enumerate(parts) if (i, n) not in gone), [n for n in range(len(parts)) if (i, n) in gone])
    return out


def smith_waterman(a, b, match=2, miss=-1, gap=-1):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (match if x == y else miss), row[j] + gap, new[j - 1] + gap))
        best, row = max(best, *new), new
    return best


def find(docs, items, seed=3, share=0.4, long=60, least=8):
    """Every document aligned whole with every item of which it has three words in a row."""
    plain = lambda t: [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for w in (t or "").split() if w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")]
    out = set()
    for d, t in docs:
        x = plain(t)
        for i, u in items:
            y = plain(u)
            k = min(seed, len(y))
            if y and {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} & {tuple(y[a : a + k]) for a in range(len(y) - k + 1)}:
                score = smith_waterman(x, y)
                if score >= 2 * len(y) * (share if len(y) >= least else 1) or score >= long:
                    out.add((d, i, score))
    return out
