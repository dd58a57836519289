"""Joins on hashed keys in packed form.

A corpus has as many rolling windows or n-grams as it has words, and as plain
rows their hashes take several times the space of the texts. Here the texts
are dealt into chunks of bounded size, and each chunk sends its *distinct*
keys, sorted and packed as short differences, to the buckets that the key
space is cut into. A bucket sees the keys of all chunks, aggregates them, and
answers each chunk with one value per key in the order sent. The answers are
joined back to the chunk, which computes the same order again.

A key that stands in a third of all rows reaches its bucket once per chunk.
A chunk and a bucket are one task's work each: about ``chunk_bytes`` of text,
or the keys of as much text. Larger executors can take larger chunks.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.llm.shared_store import bound_batches
from geotrends.llm.words import word_hashes

CHUNK_BYTES = 8 << 20
REQUEST = "bucket int, chunk int, part int, keys binary, extra binary"
REPLY = "chunk int, kind int, bucket int, part int, data binary"
# Keys in a packed row at most, so that no single value grows with a chunk.
_MOST = 1 << 20


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, *more) -> tuple[DataFrame, int]:
    """(chunk, key, text, more...) with the rows dealt into chunks by hash, and the number of chunks.

    Rows are dealt by id and text, so rows that repeat an id do not pile up.
    One pass over the texts' lengths finds the number. Texts travel compressed;
    :func:`ordered` opens them.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"), *more)
    size = rows.select(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / chunk_bytes))
    chunk = F.pmod(F.xxhash64("key", "text"), F.lit(n)).cast("int").alias("chunk")
    dealt = rows.select(chunk, *rows.columns)
    squeezed = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(_squeeze, squeezed).repartition(n, "chunk"), n


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [None if x is None else press.compress(x) for x in batch["text"].cast(pa.binary()).to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.binary()))


def ordered(table: pa.Table, *more: str) -> pa.Table:
    """Rows of a chunk, texts opened, in an order that depends on their values alone."""
    open_ = zstandard.ZstdDecompressor()
    texts = [None if x is None else open_.decompress(x) for x in table["text"].to_pylist()]
    table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("key", "text", *more)])
    return table.take(order)


class Words:
    """Word hashes of a chunk's texts, end to end."""

    def __init__(self, texts: pa.ChunkedArray, lower: bool):
        hashes, sizes = [], []
        for data in texts.cast(pa.binary()):
            data = data.as_py() or b""
            h = word_hashes((data.lower() if lower else data).split())
            hashes.append(h)
            sizes.append(len(h))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def inside(self, size: int) -> np.ndarray:
        """For each window of ``size`` words of the whole chunk, whether it lies in one text."""
        n = max(0, len(self.hashes) - size + 1)
        return np.arange(n) + size <= np.repeat(self.ends, self.sizes)[:n]


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, byte by byte side by side, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _from_planes(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    raw = np.frombuffer(pa.decompress(data[9:], width * n, "zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view("<u8").ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, at least one, as differences.

    The low bytes of a difference are random and stand as they are; what is
    above them is small and compressed.
    """
    steps = np.diff(keys)
    mean = (int(keys[-1]) - int(keys[0])) // max(1, len(steps))
    low = max(0, (mean.bit_length() - 2) // 8)
    raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes()
    head = bytes([low]) + len(steps).to_bytes(8, "little") + int(keys[0]).to_bytes(8, "little")
    return head + raw + _planes(steps >> np.uint64(8 * low))


def unpack(data: bytes) -> np.ndarray:
    low, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n + 1, 8), np.uint8)
    out[1:, :low] = np.frombuffer(data, np.uint8, n * low, 17).reshape(n, low)
    out = out.view("<u8").ravel()
    out[1:] |= _from_planes(data[17 + n * low :]) << np.uint64(8 * low)
    out[0] = int.from_bytes(data[9:17], "little")
    return np.cumsum(out, dtype=np.uint64)


def _pieces(keys: np.ndarray, n_buckets: int, bits: int) -> Iterator[tuple[int, int, int, int]]:
    """(bucket, part, from, to) of sorted keys; buckets are equal ranges of the key space."""
    edges = np.array([-(-(b << bits) // n_buckets) for b in range(1, n_buckets)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for bucket in range(n_buckets):
        for part, low in enumerate(range(cuts[bucket], cuts[bucket + 1], _MOST)):
            yield bucket, part, low, min(low + _MOST, cuts[bucket + 1])


def requests(chunk: int, keys: np.ndarray, n_buckets: int, bits: int, extra: Callable[[int, int], bytes]) -> pa.Table:
    """The packed keys of a chunk by bucket, with ``extra(from, to)`` beside each slice."""
    rows = [(b, chunk, p, pack(keys[i:j]), extra(i, j)) for b, p, i, j in _pieces(keys, n_buckets, bits)]
    pa.default_memory_pool().release_unused()
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 5
    return pa.table({c: pa.array(v, t) for c, t, v in zip(("bucket", "chunk", "part", "keys", "extra"), types, columns)})


def answered(asked: DataFrame, kind: int, n_buckets: int, combine: Callable) -> DataFrame:
    """Per bucket, ``combine(keys, extras) -> list of bytes``: an answer for each packed row, in order."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = [unpack(x.as_py()) for x in table["keys"]]
        data = combine(keys, [x.as_py() for x in table["extra"]])
        pa.default_memory_pool().release_unused()
        return pa.table(
            {
                "chunk": table["chunk"],
                "kind": pa.array([kind] * len(data), pa.int32()),
                "bucket": table["bucket"],
                "part": table["part"],
                "data": pa.array(data, pa.binary()),
            }
        )

    return asked.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(answer, REPLY)


def answers_of(replies: pa.Table, kind: int) -> list[bytes]:
    """A chunk's answers of one kind in the order of its keys."""
    rows = replies.filter(pc.equal(replies["kind"], kind)).sort_by([("bucket", "ascending"), ("part", "ascending")])
    return [x.as_py() for x in rows["data"]]


def pack_bits(flags: np.ndarray) -> bytes:
    """Flags with the number of them in front."""
    return flags.size.to_bytes(8, "little") + np.packbits(flags).tobytes()


def unpack_bits(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=n).astype(bool)


def pack_counts(counts: np.ndarray) -> bytes:
    return _planes(counts)


def unpack_counts(data: bytes) -> np.ndarray:
    return _from_planes(data)
