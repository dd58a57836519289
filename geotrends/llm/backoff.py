"""Stupid-backoff scores from n-gram counts of the whole corpus.

Every chunk of texts sends its distinct n-grams of all orders with their counts
to buckets by hash; a bucket adds them up into its part of the count table and
answers each chunk with the corpus counts of the n-grams it asked for
(``keyblocks``). A chunk then scores its words and sums them per document.
What moves grows with the corpus; a very common n-gram moves once per chunk.

    S(w | u v) = c(u v w) / c(u v)         if c(u v w) >= min_count
               = backoff * S(w | v)        otherwise
    S(w)       = max(c(w), 1) / max(N, 1)
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.llm import keyblocks as kb
from geotrends.llm.words import BASES, mix, windows

_COUNTS = 1
RESULT = "key bigint, n_words bigint, n_backoff bigint, log_score double"
# The key of the number of all words; no n-gram hash is expected to meet it.
_TOTAL = np.uint64(0)


class _Grams:
    """N-grams of a chunk: sorted distinct keys, and the place of each word's own n-gram of each order (-1: none)."""

    def __init__(self, words: kb.Words, order: int):
        every, at = [], []
        for n in range(1, order + 1):
            where = np.flatnonzero(words.inside(n))
            # The order is part of the key: a word and a pair never meet.
            every.append(mix(windows(words.hashes, n, BASES[1])[where] + np.uint64(n)))
            at.append(where)
        joined = np.concatenate([np.array([_TOTAL]), *every])
        self.keys, places = np.unique(joined, return_inverse=True)
        self.places, low = [], 1
        for n, (keys, where) in enumerate(zip(every, at), 1):
            place = np.full(len(words.hashes), -1)
            place[where + n - 1] = places[low : low + len(keys)]
            self.places.append(place)
            low += len(keys)


def _sum(keys: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
    """The corpus counts of a bucket, for each chunk's keys."""
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.zeros(place.max() + 1, np.uint64)
    np.add.at(counts, place, np.concatenate([kb.unpack_counts(x) for x in extras]))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return [kb.pack_counts(x) for x in np.split(counts[place], cuts)]


def backoff_scores(
    docs: DataFrame,
    corpus: DataFrame | None = None,
    order: int = 3,
    backoff: float = 0.4,
    min_count: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = kb.CHUNK_BYTES,
) -> DataFrame:
    """A row per document of ``docs``: ``id_col``, n_words, n_backoff, log_score.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. ``log_score`` is the
    natural logarithm of the product of the words' scores, ``n_backoff`` the
    number of words that were not scored by the longest n-gram their place
    allows. N-grams are counted in ``corpus``, or in ``docs`` themselves; those
    of two words or more count as seen from ``min_count`` occurrences, so a
    document's own single occurrence is no evidence. Null and empty texts have no words
    and score 0. Repeated rows are counted and scored each. Other columns are
    left out.
    """
    flagged = lambda df, counted, scored: df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("key"), F.col(f"`{text_col}`").alias("text"),
        F.lit(counted).alias("counted"), F.lit(scored).alias("scored"),
    )
    if corpus is None:
        rows = flagged(docs, True, True)
    else:
        rows = flagged(docs, False, True).unionByName(flagged(corpus, True, False))
    dealt, n = kb.chunked(rows, "key", "text", chunk_bytes, "counted", "scored")

    def tables(table: pa.Table):
        table = kb.ordered(table, "counted", "scored")
        words = kb.Words(table["text"], True)
        return table, words, _Grams(words, order)

    def ask(table: pa.Table) -> pa.Table:
        table, words, grams = tables(table)
        counted = np.repeat(np.array(table["counted"].to_pylist(), bool), words.sizes)
        counts = np.zeros(len(grams.keys), np.int64)
        for place in grams.places:
            counts += np.bincount(place[(place >= 0) & counted], minlength=len(counts))
        counts[0] += counted.sum() if grams.keys[0] == _TOTAL else 0
        return kb.requests(table["chunk"][0].as_py(), grams.keys, n, 64, lambda i, j: kb.pack_counts(counts[i:j]))

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        table, words, grams = tables(table)
        counts = np.concatenate([kb.unpack_counts(x) for x in kb.answers_of(replies, _COUNTS)]).astype(np.float64)
        total, size = max(counts[0], 1.0), len(words.hashes)
        own = lambda k: np.where(grams.places[k] >= 0, counts[grams.places[k]], 0.0)
        c = own(0)
        s = np.maximum(c, 1.0) / total
        longest = np.zeros(size, np.int64)
        for k in range(1, order):
            before = np.concatenate([[0.0], own(k - 1)[:-1]])  # the context is the shorter n-gram that ends one word earlier
            here = own(k)
            possible = grams.places[k] >= 0
            seen = possible & (here >= min_count)
            s = np.where(seen, here / np.maximum(before, 1.0), np.where(possible, backoff * s, s))
            longest = np.where(possible, np.where(seen, 0, 1), longest)
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[np.append(0, words.ends)])
        logs = np.log(s)
        scored = np.array(table["scored"].to_pylist(), bool)
        score = [float(logs[a:b].sum()) for a, b in zip(words.starts, words.ends)]
        return pa.table(
            {
                "key": table["key"],
                "n_words": pa.array(words.sizes),
                "n_backoff": pa.array(sums(longest).astype(np.int64)),
                "log_score": pa.array(score, pa.float64()),
            }
        ).filter(pa.array(scored))

    texts = dealt.groupBy("chunk")
    counts = kb.answered(texts.applyInArrow(ask, kb.REQUEST), _COUNTS, n, _sum)
    result = texts.cogroup(counts.groupBy("chunk")).applyInArrow(score, RESULT)
    return result.select(F.col("key").alias(id_col), "n_words", "n_backoff", "log_score")
