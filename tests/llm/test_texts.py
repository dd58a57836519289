"""Operators on whole texts against plain versions."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from geotrends.llm.backoff import backoff_scores
from geotrends.llm.decontaminate import best_stretch, benchmark_overlaps, overlapping_rows, text_hashes
from geotrends.llm.near_dups import near_duplicates
from geotrends.llm.repeats import remove_repeats


@pytest.mark.parametrize("chunk_bytes", [3000, 8 << 20])
def test_repeats(make_docs, prose, chunk_bytes):
    out = remove_repeats(make_docs(prose), chunk_bytes=chunk_bytes).collect()
    found = {r["doc_id"]: (r["n_words"], r["kept"]) for r in out}
    assert found == dict(enumerate(brute.remove_repeats(prose)))
    for r in out:
        own = brute.words(prose[r["doc_id"]])
        gone = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert len(gone) == r["n_removed"]
        assert b" ".join(w for i, w in enumerate(own) if i not in gone).decode() == r["kept"]


@pytest.mark.parametrize("window", [2, 5, 12])
def test_repeats_of_other_sizes(make_docs, prose, window):
    out = remove_repeats(make_docs(prose), window=window, chunk_bytes=20_000).collect()
    assert {r["doc_id"]: (r["n_words"], r["kept"]) for r in out} == dict(enumerate(brute.remove_repeats(prose, window)))


def test_repeats_edges(make_docs):
    assert remove_repeats(make_docs([])).count() == 0
    same = " ".join(f"w{i}" for i in range(40))
    rows = remove_repeats(make_docs([same, same, None], [1, 1, None]), carry=["lang", "key"]).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["carried"]["key"]) for r in rows) == [(0, 0, "x"), (1, 40, "x"), (1, 40, "x")]


@pytest.mark.parametrize("chunk_bytes", [3000, 8 << 20])
def test_backoff(make_docs, prose, chunk_bytes):
    out = {r["doc_id"]: r for r in backoff_scores(make_docs(prose), chunk_bytes=chunk_bytes).collect()}
    expected = brute.backoff_scores(prose, prose)
    assert len(out) == len(prose)
    for i, score in enumerate(expected):
        assert out[i]["log_score"] == pytest.approx(score, abs=1e-6)
        assert out[i]["n_words"] == len(brute.words(prose[i]))


def test_backoff_with_another_corpus(make_docs, prose):
    docs, corpus = prose[:20] + ["never seen words"], prose[20:]
    scores = backoff_scores(make_docs(docs), make_docs(corpus), order=2, backoff=0.3, min_count=1, chunk_bytes=2000)
    out = {r["doc_id"]: r["log_score"] for r in scores.collect()}
    for i, score in enumerate(brute.backoff_scores(docs, corpus, 2, 0.3, 1)):
        assert out[i] == pytest.approx(score, abs=1e-6)
    assert backoff_scores(make_docs([]), make_docs(corpus)).count() == 0
    assert backoff_scores(make_docs(["a b"]), make_docs([])).first()["log_score"] == pytest.approx(-0.9162907)


def test_near_duplicates(make_docs, prose):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(make_docs(prose)).collect()}
    expected = brute.near_duplicates(list(enumerate(prose)))
    assert out == {i: (n, c, i == c) for i, (n, c) in expected.items()}
    sizes = [sum(1 for c in expected.values() if c[1] == i) for i in expected]
    assert max(sizes) > 10


def test_near_duplicates_chain(make_docs):
    """Links between texts that no pivot meets: each is like the next one only, at the limit itself."""
    w = [f"w{i}" for i in range(400)]
    # 5-word shingles of 104 words are 100; a shift by 14 leaves 86 of 114 in common: 75.4 %; by 15 it is 73.9 %.
    texts = [" ".join(w[14 * k : 14 * k + 104]) for k in range(12)] + [" ".join(w[300:390]), " ".join(w[315:405])]
    # 3 of 4 shingles in common: exactly the limit.
    texts += ["a b c d e f g", "a b c d e f g h"]
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(texts)).collect()}
    assert out == {i: c for i, (_, c) in brute.near_duplicates(list(enumerate(texts))).items()}
    assert out[11] == 0 and out[13] == 13 and out[15] == 14


def test_near_duplicates_edges(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    text = "a b c d e f g h"
    out = near_duplicates(make_docs([text, text, text, None], [5, 5, None, 9])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in out) == [
        (0, 5, False), (5, 5, True), (5, 5, True), (9, 9, True)
    ]


ITEMS = [
    (1, " ".join(f"q{i}" for i in range(30))),
    (2, "Short item of five words"),
    (3, None),
    (4, ""),
    (5, " ".join(f"r{i}" for i in range(20))),
    (5, " ".join(f"r{i}" for i in range(20))),
]


def _benchmark(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, key string")


def _contaminated():
    q, r = ITEMS[0][1].split(), ITEMS[4][1].split()
    filler = [f"f{i}" for i in range(50)]
    replaced = list(q)
    replaced[7] = replaced[15] = "other"
    return [
        " ".join(filler), " ".join(filler[:9] + q + filler[9:]), " ".join(filler + replaced), "A SHORT ITEM, of five words!",
        " ".join(filler[:3] + q[10:24] + filler[3:]), " ".join(q[:11] + filler), " ".join(r + q + r), None, "", "short item of",
        " ".join(filler * 400 + r),
    ]


@pytest.mark.parametrize("hot_rows", [1, 1 << 18])
def test_decontamination(spark, make_docs, hot_rows):
    texts = _contaminated()
    items = [(i, t) for i, t in ITEMS if t]
    out = benchmark_overlaps(make_docs(texts), _benchmark(spark), hot_rows=hot_rows).collect()
    expected = {(d, k) for d, t in enumerate(texts) for k in brute.overlapped(t, items)}
    assert {(r["doc_id"], r["item_id"]) for r in out} == expected
    assert {d for d, _ in expected} == {1, 2, 3, 4, 6, 10}
    place = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in out}
    assert place[1, 1] == (9, 0, 30, 30) and place[2, 1] == (50, 0, 30, 28) and place[4, 1] == (3, 10, 14, 14)
    flagged = overlapping_rows(make_docs(texts), "doc_id", _benchmark(spark)).collect()
    assert {r[0] for r in flagged} == {d for d, _ in expected}


def test_very_short_items_reject_whole_texts_only(spark, make_docs):
    items = spark.createDataFrame([(1, "the"), (2, "in the"), (3, "one two three four five")], "item_id bigint, text string")
    texts = ["This is the end", "cats in the house", "The!", "IN  the", "in the the", "zero one two three four five six", None, ""]
    flagged = overlapping_rows(make_docs(texts), "doc_id", items).collect()
    assert {r[0] for r in flagged} == {2, 3, 5}
    found = {(r["doc_id"], r["item_id"]) for r in benchmark_overlaps(make_docs(texts), items).collect()}
    assert found == {(0, 1), (1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (5, 3)}


def test_decontamination_edges(spark, make_docs):
    nothing = _benchmark(spark).where("false")
    assert benchmark_overlaps(make_docs(["a b"]), nothing).count() == 0
    assert benchmark_overlaps(make_docs([]), _benchmark(spark)).count() == 0
    assert overlapping_rows(make_docs(["a b", None]), "doc_id", nothing).count() == 0


def test_decontamination_replaced_words(spark, make_docs):
    """Every k-th word replaced, at every phase, and random replacements, against the best stretch of each diagonal."""
    rng = random.Random(3)
    item = [f"w{rng.randrange(1000)}" for _ in range(120)]
    texts = [" ".join("x" if i % k == p else w for i, w in enumerate(item)) for k in (4, 5, 6, 7) for p in range(k)]
    texts += [" ".join("x" if rng.random() < 0.15 else w for w in item[s : s + 30]) for s in range(60)]
    # Runs of equal words, in which every word meets every other.
    texts += ["so " * 300 + " ".join(item[:9]), " ".join(item[:20]) * 2]
    items = [(1, " ".join(item)), (2, "so " * 40), (None, " ".join(item[:20])), (1, " ".join(item[:20]))]
    out = benchmark_overlaps(make_docs(texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    expected = []
    for d, text in enumerate(texts):
        h = text_hashes(text.encode())
        for i, t in items:
            w, best = text_hashes(t.encode()), None
            for shift in range(1 - len(w), len(h)):
                low, high = max(0, -shift), min(len(w), len(h) - shift)
                a, b, matched = best_stretch(h[low + shift : high + shift] == w[low:high])
                place = (-matched, a + low + shift, a + low, b - a, matched)
                best = place if matched >= 12 and (best is None or place < best) else best
            if best:
                expected.append((d, i, *best[1:]))
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)
    assert {d for d, *_ in expected} >= set(range(22))


def test_decontamination_repeated_rows(spark, make_docs):
    texts = ["pre " + ITEMS[0][1]] * 3
    out = benchmark_overlaps(make_docs(texts, [7, 7, None]), _benchmark(spark)).collect()
    assert sorted(((r["doc_id"], r["doc_start"]) for r in out), key=str) == [(7, 1), (7, 1), (None, 1)]
