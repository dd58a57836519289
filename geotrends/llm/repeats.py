"""Removal of passages that repeat, by fixed-block anchors.

A window of ``window`` words holds a whole block of ``window // 2`` words of any
grid of such blocks (18 for 35). So the non-overlapping blocks of every text
are the index, and every rolling block of every text probes it. A hit marks the
only windows that can repeat; these are compared by two independent
fingerprints (96 bits), and overlapping repeated windows make up the maximal
exact repeats. Both steps are joins on packed keys (``keyblocks``), so a
passage that stands in a third of the rows is sent once per chunk of texts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.llm import keyblocks as kb
from geotrends.llm.words import BASES, windows

# Bits of a block's key. A false hit only costs a comparison of windows.
_BLOCK_BITS = 48
_HITS, _REPEATS = 1, 2
# Half of the usual size: the last step holds texts, blocks and windows of a chunk at once.
CHUNK_BYTES = 4 << 20
RESULT = "key bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start: bigint, end: bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _first_of_runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)


class _Blocks:
    """Distinct rolling blocks of a chunk, sorted: key, whether one is on the grid, whether it stands twice."""

    def __init__(self, words: kb.Words, block: int):
        inside = words.inside(block)
        at = np.flatnonzero(inside)
        keys = (windows(words.hashes, block) >> np.uint64(64 - _BLOCK_BITS))[at]
        on_grid = (at - np.repeat(words.starts, words.sizes)[at]) % block == 0
        order = np.argsort(keys)
        ordered = keys[order]
        del keys, inside
        first = _first_of_runs(ordered)
        self.keys = ordered[first]
        self.anchor = np.logical_or.reduceat(on_grid[order], first) if len(first) else np.empty(0, bool)
        self.twice = np.diff(np.append(first, len(ordered))) > 1
        self.group = np.empty(len(at), np.int32)  # place in self.keys of each position
        self.group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ordered))))
        self.at = at.astype(np.int32)


class _Windows:
    """Distinct candidate windows of a chunk, by two fingerprints."""

    def __init__(self, words: kb.Words, blocks: _Blocks, hit: np.ndarray, window: int, block: int):
        n = max(0, len(words.hashes) - window + 1)
        marks = np.zeros(len(words.hashes) + 1, np.int64)
        marks[blocks.at[hit[blocks.group]] + 1] = 1
        marks = np.cumsum(marks)
        # A hit at one of the first window - block + 1 positions lies wholly in the window.
        near = marks[window - block + 1 : window - block + 1 + n] > marks[:n]
        self.at = np.flatnonzero(near & words.inside(window))
        del marks, near
        one = windows(words.hashes, window, BASES[0])[self.at]
        two = (windows(words.hashes, window, BASES[1])[self.at] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        self.twice = np.diff(np.append(first, len(one))) > 1
        self.group = np.empty(len(one), np.int32)
        self.group[order] = np.cumsum(new) - 1
        self.one, self.two = one[first], two[first]


def _hits(keys: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
    """Blocks that stand at two places at least, one of them on a grid."""
    flags = [kb.unpack_bits(x).reshape(2, -1) for x in extras]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    anchor = np.bincount(place, np.concatenate([f[0] for f in flags]), len(found)) > 0
    places = np.bincount(place, np.concatenate([f[1] for f in flags]).astype(float) + 1, len(found)) > 1
    return _dealt((anchor & places)[place], keys)


def _repeats(keys: list[np.ndarray], extras: list[bytes]) -> list[bytes]:
    """Windows whose two fingerprints stand at two places at least."""
    ends = [8 + (len(k) + 7) // 8 for k in keys]
    twice = np.concatenate([kb.unpack_bits(x[:e]) for x, e in zip(extras, ends)])
    two = np.concatenate([np.frombuffer(x, np.uint32, offset=e) for x, e in zip(extras, ends)])
    one = np.concatenate(keys)
    order = np.lexsort((two, one))
    new = np.ones(len(one), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.cumsum(new) - 1
    places = np.bincount(group, twice[order].astype(float) + 1) > 1
    out = np.empty(len(one), bool)
    out[order] = places[group]
    return _dealt(out, keys)


def _dealt(flags: np.ndarray, like: list[np.ndarray]) -> list[bytes]:
    cuts = np.cumsum([len(k) for k in like])[:-1]
    return [kb.pack_bits(x) for x in np.split(flags, cuts)]


def _flags(replies: pa.Table, kind: int) -> np.ndarray:
    parts = [kb.unpack_bits(x) for x in kb.answers_of(replies, kind)]
    return np.concatenate(parts) if parts else np.empty(0, bool)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 35,
    chunk_bytes: int = CHUNK_BYTES,
    carry: list[str] | None = None,
    as_is: bool = False,
) -> DataFrame:
    """A row per document: ``id_col``, n_words, n_removed, kept, spans.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every word is removed that
    lies in ``window`` consecutive words of its document whose sequence also
    starts anywhere else, in the same document or another; every occurrence
    goes. Windows are judged on the input. ``kept`` is the kept words joined by
    one blank, ``spans`` the removed stretches as word numbers. A null or
    empty text, or one shorter than the window, loses nothing. Rows that
    repeat an id are documents of their own, and equal rows repeat each other.
    With ``as_is`` a text that loses nothing is kept with its own blanks.
    Columns named in ``carry`` are returned unchanged in a struct ``carried``;
    others are left out.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    block = (window + 1) // 2
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    dealt, n = kb.chunked(docs, id_col, text_col, chunk_bytes, *more)
    result_type = f"{RESULT}, carried {dealt.schema['carried'].dataType.simpleString()}" if carry else RESULT

    def probe(table: pa.Table) -> pa.Table:
        blocks = _Blocks(kb.Words(kb.ordered(table)["text"], False), block)
        both = np.stack([blocks.anchor, blocks.twice])
        return kb.requests(table["chunk"][0].as_py(), blocks.keys, n, _BLOCK_BITS, lambda i, j: kb.pack_bits(both[:, i:j]))

    def compare(table: pa.Table, replies: pa.Table) -> pa.Table:
        words = kb.Words(kb.ordered(table)["text"], False)
        blocks = _Blocks(words, block)
        found = _Windows(words, blocks, _flags(replies, _HITS), window, block)
        return kb.requests(
            table["chunk"][0].as_py(), found.one, n, 64,
            lambda i, j: kb.pack_bits(found.twice[i:j]) + found.two[i:j].tobytes(),
        )

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = kb.ordered(table)
        words = kb.Words(table["text"], False)
        blocks = _Blocks(words, block)
        found = _Windows(words, blocks, _flags(replies, _HITS), window, block)
        change = np.zeros(len(words.hashes) + 1, np.int64)
        at = found.at[_flags(replies, _REPEATS)[found.group]]
        change[at] += 1
        np.subtract.at(change, at + window, 1)
        gone = np.cumsum(change)[:-1] > 0
        kept, removed, spans = [], [], []
        for data, low, high in zip(table["text"].cast(pa.binary()), words.starts, words.ends):
            own = gone[low:high]
            own_words = (data.as_py() or b"").split()
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
            stays, last = [], 0
            for a, b in edges:
                stays += own_words[last:a]
                last = b
            stays += own_words[last:]
            kept.append(data.as_py() if as_is and not edges else b" ".join(stays))
            removed.append(int(own.sum()))
            spans.append([{"start": a, "end": b} for a, b in edges])
        columns = {"carried": table["carried"]} if carry else {}
        return pa.table(
            {
                "key": table["key"].cast(pa.int64()),
                "n_words": pa.array(words.sizes),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "spans": pa.array(spans, _SPANS),
                **columns,
            }
        )

    texts = dealt.groupBy("chunk")
    hits = kb.answered(texts.applyInArrow(probe, kb.REQUEST), _HITS, n, _hits)
    asked = texts.cogroup(hits.groupBy("chunk")).applyInArrow(compare, kb.REQUEST)
    repeats = kb.answered(asked, _REPEATS, n, _repeats)
    result = texts.cogroup(hits.unionByName(repeats).groupBy("chunk")).applyInArrow(remove, result_type)
    return result.withColumnRenamed("key", id_col)
