"""Packing token sequences into windows of fixed length with bounded space.

Each partition keeps at most ``max_open`` open windows. A document fills whole
windows of its own; what is left of it goes to the open window where it fits
best. When it fits in none and all windows are open, the fullest one is
emitted, filled up with the head of the document if the gap is worth a cut.
The windows still open at the end of a partition are leftovers: they are merged
in groups of a fixed number of partitions, so no task ever gets all of them.

Token ids come from a public tokenizer. Its splitting pattern never joins two
words over a blank or line end that stands between two non-blanks, so each text
is cut there and each distinct piece is encoded once, as long as it is remembered.
"""

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.llm.shared_store import bound_batches, written

# Before a blank between two non-blanks. Python counts more characters as blank
# than the tokenizer does, which only leaves some pieces longer.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_WORD = re.compile(r" [A-Za-z]+[,.;:!?]?\Z")
_BLANK = "\u0120"  # how a byte-level model writes a blank
_BLOCK_CHARS = 1 << 20
_MOST_PIECES = 500_000
_JOINED = 1000


class Pieces:
    """Token ids of whole texts by way of their distinct pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        # A byte-level token is written with one character per byte.
        self.size_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.size_of[number] = len(token)
        self.model = self.tokenizer.model
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ",.;:!?"}
        self._reset()

    def _reset(self) -> None:
        self.inner, self.whole = _Numbers(self, " "), _Numbers(self, "")
        self.new: list[str] = []
        self.apart: list[bool] = []
        self.odd = np.empty(0, bool)
        self.flat, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.odd) > _MOST_PIECES:
            self._reset()
        numbers = []
        for text in texts:
            parts = (text or "").replace("\n", " \n").split(" ")
            found = [self.whole[parts[0]], *map(self.inner.__getitem__, parts[1:])] if text else []
            numbers.append(np.array(found, np.int64))
        self._encode_new()
        for k, text in enumerate(texts):
            if text and self.odd[numbers[k]].any():  # blanks side by side
                numbers[k] = np.array([self.whole[p] for p in _CUT.split(text)], np.int64)
        self._encode_new()
        lengths = np.diff(self.starts)
        out = []
        for found in numbers:
            size = lengths[found]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            at = np.arange(total) + np.repeat(self.starts[found] - (ends - size), size)
            out.append(self.flat[at])
        return out

    def _word_ids(self, piece: str) -> list[int]:
        letters = piece[1:] if piece[-1].isalpha() else piece[1:-1]
        ids = [t.id for t in self.model.tokenize(_BLANK + letters)]
        return ids if piece[-1].isalpha() else ids + self.marks[piece[-1]]

    def _encode_new(self) -> None:
        """Ids of the new pieces. Most are words; others between single blanks are encoded as one text
        of many; the bytes that each token stands for tell where a piece ends."""
        if not self.new:
            return
        odd = np.array([not p.strip(" ") or p[-1].isspace() or p[1:2].isspace() for p in self.new])
        apart = odd | np.array(self.apart)
        # A blank and letters are one word of the pattern, a mark after them another: the model takes them as they are.
        words = [] if apart.all() else [i for i in np.flatnonzero(~apart).tolist() if _WORD.match(self.new[i])]
        word_ids = [self._word_ids(self.new[i]) for i in words]
        others = ~apart
        others[words] = False
        joined = np.flatnonzero(others).tolist()
        order = [*np.flatnonzero(apart).tolist(), *joined]
        strings = [self.new[i] for i in order[: len(order) - len(joined)]]
        strings += ["".join([self.new[i] for i in joined[k : k + _JOINED]]) for k in range(0, len(joined), _JOINED)]
        encoded = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.uint32)
        byte_ends = np.cumsum([len(self.new[i].encode()) for i in order], dtype=np.int64)
        token_ends = np.where(byte_ends, np.searchsorted(np.cumsum(self.size_of[ids]), byte_ends, "left") + 1, 0)
        sizes = np.concatenate([np.diff(token_ends, prepend=0), [len(x) for x in word_ids]]).astype(np.int64)
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(word_ids), np.uint32)])
        order += words
        token_ends = np.cumsum(sizes)
        # Back to the order in which the pieces were numbered.
        own_sizes = np.empty(len(order), np.int64)
        own_sizes[order] = sizes
        starts_of = np.empty(len(order), np.int64)
        starts_of[order] = token_ends - sizes
        ends = np.cumsum(own_sizes)
        at = np.arange(len(ids)) + np.repeat(starts_of - (ends - own_sizes), own_sizes)
        self.starts = np.concatenate([self.starts, ends + len(self.flat)])
        self.flat = np.concatenate([self.flat, ids[at]])
        self.odd = np.concatenate([self.odd, odd])
        self.new, self.apart = [], []


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One per Python worker and tokenizer: only the first partition reads the tokenizer's file."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


class _Numbers(dict):
    """Numbers the pieces it is asked for; ``lead`` stands before each of them that begins no line."""

    def __init__(self, pieces: Pieces, lead: str):
        self.pieces, self.lead = pieces, lead

    def __missing__(self, part: str) -> int:
        p = self.pieces
        number = self[part] = len(p.odd) + len(p.new)
        p.new.append(part if part[:1] == "\n" else self.lead + part)
        p.apart.append(not self.lead)
        return number


class Packer:
    """Bounded-space best fit over pieces (start, length); sequences are numbered from ``first``."""

    def __init__(self, window: int, max_open: int, min_cut: int, first: int):
        self.window, self.max_open, self.min_cut = window, max_open, min_cut
        self.next, self.open = first, {}  # number of the sequence -> tokens used
        self.closed: list[int] = []  # since the caller last emptied it

    def _new(self, used: int) -> int:
        number, self.next = self.next, self.next + 1
        if used < self.window:
            self.open[number] = used
        else:
            self.closed.append(number)
        return number

    def _close(self, number: int) -> None:
        del self.open[number]
        self.closed.append(number)

    def place(self, length: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of a document."""
        out, start = [], 0
        while length - start >= self.window:
            out.append((start, self.window, self._new(self.window), 0))
            start += self.window
        rest = length - start
        if not rest:
            return out
        fitting = [(self.window - used, number) for number, used in self.open.items() if self.window - used >= rest]
        if not fitting and len(self.open) >= self.max_open:
            used, number = max((used, -number) for number, used in self.open.items())
            number = -number
            self._close(number)
            gap = self.window - used
            if gap >= self.min_cut:
                out.append((start, gap, number, used))
                start, rest = start + gap, rest - gap
            fitting = [(self.window - u, n) for n, u in self.open.items() if self.window - u >= rest]
        if fitting:
            _, number = min(fitting)
            used = self.open[number]
            out.append((start, rest, number, used))
            self.open[number] = used + rest
            if used + rest == self.window:
                self._close(number)
        else:
            out.append((start, rest, self._new(rest), 0))
        return out


_PIECE = pa.schema(
    [
        ("key", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("leftover", pa.int64()),
    ]
)
PIECE_TYPE = (
    "key bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint,"
    " leftover bigint"
)
# Sequences are numbered part * 2^33 + count; merged ones add 2^32.
_SPAN, _MERGED = 1 << 33, 1 << 32


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 1024,
    max_open: int = 64,
    min_cut: int = 8,
    end_id: int = 0,
    merge_parts: int = 64,
) -> DataFrame:
    """Pieces (``id_col``, start, length, ids, doc_tokens, sequence_id, offset) of the packed documents.

    ``ids`` are the token ids as little-endian unsigned 32-bit numbers; each
    document ends with ``end_id``, so null and empty texts have that one
    token. Every token lies in exactly one piece, and the pieces of a sequence
    lie side by side from offset 0. Repeated rows and ties are packed each by
    itself; null ids are kept. Other columns are left out.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(tokenizer)
        packer = Packer(window, max_open, min_cut, TaskContext.get().partitionId() * _SPAN)
        held: dict[int, list[tuple]] = {}  # rows of open windows
        for batch in batches:
            keys, column = batch["key"].to_pylist(), batch["text"]
            at = 0
            while at < len(keys):
                block, chars = [], 0
                while at + len(block) < len(keys) and (not block or chars < _BLOCK_CHARS):
                    block.append(column[at + len(block)].as_py())
                    chars += len(block[-1] or "")
                done = []
                for key, ids in zip(keys[at : at + len(block)], pieces.encode(block)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for s, n, number, offset in packer.place(len(ids)):
                        row = (key, s, n, ids[s : s + n].tobytes(), len(ids), number, offset, 0)
                        held.setdefault(number, []).append(row)
                    for number in packer.closed:
                        done += held.pop(number)
                    packer.closed.clear()
                at += len(block)
                if done:
                    yield _rows(done)
        if held:
            yield _rows([(*row[:-1], 1) for number in sorted(held) for row in held[number]])

    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("key"), F.col(f"`{text_col}`").alias("text"))
    placed = written(texts.mapInArrow(place, PIECE_TYPE), "packing", ["leftover"])
    group = F.floor(F.col("sequence_id") / F.lit(_SPAN * merge_parts))
    merged = (
        placed.where("leftover = 1")
        .withColumn("part", group)
        .groupBy("part")
        .applyInArrow(lambda t: _merge(t, window, merge_parts * _SPAN), PIECE_TYPE)
    )
    out = placed.where("leftover = 0").unionByName(merged)
    return out.select(F.col("key").alias(id_col), *_PIECE.names[1:-1])


def _merge(left: pa.Table, window: int, group_span: int) -> pa.Table:
    """Lay the pieces of leftover windows end to end and cut that row into full windows.

    A group holds at most ``max_open`` windows of each of ``merge_parts`` partitions.
    """
    columns = left.select(_PIECE.names[:-1]).to_pydict()
    rows = sorted(zip(*columns.values()), key=lambda r: (r[5], r[6]))
    base = rows[0][5] // group_span * group_span + _MERGED
    out, total = [], 0
    for key, start, length, ids, doc_tokens, _number, _offset in rows:
        skip = 0
        while skip < length:
            take = min(length - skip, window - total % window)
            part = ids[4 * skip : 4 * (skip + take)]
            out.append((key, start + skip, take, part, doc_tokens, base + total // window, total % window, 1))
            skip, total = skip + take, total + take
    return pa.Table.from_batches([_rows(out)])
