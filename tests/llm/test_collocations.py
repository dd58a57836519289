"""Collocations against a plain count, and the trie by itself."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from geotrends.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain(rows, least, percent=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3, 4):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= percent * a and inside(q) for q, b in found.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def _rows():
    rng = random.Random(3)
    names = ["a", "B", "é", "Éa", "the", "of", "x y", " ", "q\x1cr"]
    rows = []
    for lang in ("en", "de", None, "und", "", "en"):
        for _ in range(25):
            words = [rng.choice(names) + rng.choice(["", "", "1"]) for _ in range(rng.randint(0, 60))]
            rows.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\r\n"]) for w in words), lang))
    rows += [("New York City hall New York City", "en")] * 12 + [("New York", "en")] * 3 + [("NEW york", "en")]
    rows += [(None, "en"), ("", "en"), (" \t ", "fr"), (None, None), ("z" * 100_000 + " " + "z" * 100_000, "en")]
    rows += [("very long " * 20_000, "long")]
    return rows


@pytest.mark.parametrize("least,top", [(1, 2000), (3, 2000), (10, 7)])
def test_collocations(spark, least, top, monkeypatch):
    rows = _rows()
    frame = spark.createDataFrame([(t, x, "x", 1, "p") for t, x in rows], "text string, lang string, phrase string, n int, prefix string")
    found = [tuple(r) for r in c.collocations(frame.repartition(5), least=least, top=top).collect()]
    assert sorted(found) == sorted(_plain(rows, least, top=top))


def test_collocations_of_nothing(spark):
    frame = spark.createDataFrame([(None, None), ("", "en"), ("one", "en")], "text string, lang string")
    assert c.collocations(frame).count() == 0
    assert c.collocations(frame.limit(0)).count() == 0


def test_trie_bursts_and_spills():
    rng = np.random.default_rng(1)
    trie, plain, runs = c.HatTrie(), Counter(), Counter()
    for _ in range(30):
        # A third of the keys share a prefix; some lie at the ends.
        keys = np.concatenate([rng.integers(0, 1 << 63, 1500).astype(np.uint64) * np.uint64(2), rng.integers(0, 9000, 700).astype(np.uint64),
                               np.array([0, 2**64 - 1, 2**63], np.uint64)])
        keys, times = np.unique(keys, return_counts=True)
        trie.add(keys, times)
        plain.update(dict(zip(keys.tolist(), times.tolist())))
        if trie.size > 20_000:
            run, counts = trie.spill()
            assert np.all(run[1:] > run[:-1]) and len(run)
            runs.update(dict(zip(run.tolist(), counts.tolist())))
    assert len(trie.leaves) > 16 and max(map(len, trie.leaves)) <= c._BURST
    while trie.size:
        run, counts = trie.spill()
        runs.update(dict(zip(run.tolist(), counts.tolist())))
    assert runs == plain


def test_runs_while_counting(monkeypatch):
    """Spills in the middle, forgotten words and cut texts change nothing."""
    monkeypatch.setattr(c, "_MOST_WORDS", 12)
    full = np.full((1 << c._BITS) // 8, 255, np.uint8)
    texts = [t.encode() for t, lang in _rows() if t and lang == "en"]
    phrases, found = c._Phrases("en", full.tobytes(), full), Counter()

    def take(batches):
        for batch in batches:
            for prefix, last, n in zip(*(batch[x].to_pylist() for x in ("prefix", "last", "times"))):
                found[prefix if last is None else f"{prefix} {last}"] += n

    for text in texts:
        take(phrases.add([text]))
        if phrases.trie.size > 50:
            take(phrases.spill())
    take(phrases.drain())
    plain = Counter()
    for text in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.decode().translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in (3, 4):
                plain.update(" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
    assert found == plain
