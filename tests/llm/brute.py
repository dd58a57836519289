"""Plain versions of the operators for small inputs."""

import math
import re
from collections import Counter

import numpy as np
import xxhash


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def shingles(text, size=5):
    w = words(text, True)
    if not w:
        return set()
    size = min(size, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def near_duplicates(docs, percent=75):
    """{id: (size, component id)} for (id, text) with distinct ids in ascending order."""
    sets = [shingles(t) for _, t in docs]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    return {docs[i][0]: (len(sets[i]), docs[c][0]) for i, c in enumerate(components(len(docs), links))}


def remove_repeats(texts, window=35):
    """(number of words, kept words) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def backoff_scores(texts, corpus, order=3, backoff=0.4, min_count=2):
    counts = Counter()
    total = 0
    for t in corpus:
        w = words(t, True)
        total += len(w)
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    def score(gram):
        if len(gram) == 1:
            return max(counts[gram], 1) / max(total, 1)
        if counts[gram] >= min_count:
            return counts[gram] / max(counts[gram[:-1]], 1)
        return backoff * score(gram[1:])

    out = []
    for t in texts:
        w = words(t, True)
        out.append(sum(math.log(score(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w))))
    return out


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def overlapped(text, items, min_match=12):
    """Items of which ``min_match`` words (or all) stand in the text without gaps, at most a third replaced."""
    w, out = plain_words(text), set()
    for k, item in items:
        v = plain_words(item)
        for shift in range(-len(v), len(w)):
            same = [0 <= i + shift < len(w) and w[i + shift] == v[i] for i in range(len(v))]
            best = run = matched = 0
            for s in same:
                run, matched = (run + 1, matched + 1) if s else (run - 2, matched)
                if run <= 0:
                    run = matched = 0
                best = max(best, matched if s else 0)
            if v and best >= min(min_match, len(v)):
                out.add(k)
    return out


def follow_the_regularised_leader(rows, s):
    """Weights of (key, text, label), shard by shard and feature by feature."""
    from geotrends.llm.quality import features
    from geotrends.llm.words import mix, word_hashes

    def signed(h):
        return h - 2**64 if h >= 2**63 else h

    shards = {}
    for key, text, label in rows:
        # Spark's xxhash64 of a string: XXH64 with seed 42.
        shards.setdefault(signed(xxhash.xxh64_intdigest(key.encode(), 42)) % s.shards, []).append((key, text, label))
    total = np.zeros(2**s.bits + 1)
    for members in shards.values():
        members.sort(key=lambda r: (mix(word_hashes([r[0].encode()]))[0], r[2]))
        z, n = {}, {}

        def weight(i):
            if abs(z.get(i, 0.0)) <= s.l1:
                return 0.0
            return (math.copysign(s.l1, z[i]) - z[i]) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

        for _ in range(s.epochs):
            for _, text, label in members:
                slots, values = features((text or "").encode(), s.bits)
                x = [*zip(slots.tolist(), values.astype(np.float32).astype(float).tolist()), (2**s.bits, 1.0)]
                w = {i: weight(i) for i, _ in x}
                p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
                for i, v in x:
                    g = (p - label) * v
                    step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                    z[i], n[i] = z.get(i, 0.0) + g - step * w[i], n.get(i, 0.0) + g * g
        for i in z:
            total[i] += weight(i)
    return total / len(shards)
