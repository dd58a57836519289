"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words: the words under its ones are
hashed, those under its zeros may differ. Seeds of the benchmark and of the
documents are rows that are joined on the hash. Each hit fixes how the two lie
side by side; from it the best-scoring stretch without gaps is taken (a word that
agrees counts 1, one that differs -2), so replaced words are tolerated and
inserted ones end it.

Only document seeds that a bitmap of the benchmark's hashes admits become rows. The
bitmap has a fixed largest size; a benchmark that outgrows it lets more rows into the
join, whose result stays the same. Texts of documents without such a seed stay in
place, and the driver sees neither texts nor seeds.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrends.llm.licenses import normalized
from geotrends.llm.shared_store import bound_batches, written
from geotrends.llm.words import mix, word_hashes
from geotrends.session import materialize

# The first three span 12 words and read 7: two replaced words in any 24 leave a hit under one of them.
# The last finds what they miss: a passage in which every fourth, fifth or later word is replaced.
MASKS = ("110100110101", "101110010011", "111011001001", "11101101")
# An item with fewer words than this is too common to reject a text that only contains it.
SHORT_WORDS = 5
# Rows of one hash beyond which they are dealt to several tasks.
HOT_ROWS = 1 << 18
SEEDED = "key bigint, words binary, seeds array<struct<hash:bigint,low:bigint,high:bigint>>"
OVERLAP = "key bigint, row bigint, item bigint, item_row bigint, item_words bigint, doc_words bigint, doc_start bigint, item_start bigint, n_words bigint, n_matched bigint"
_SEED = pa.struct([("hash", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_DIFFERS = -2
_BITMAP_BITS = (1 << 26, 1 << 29)
_BUCKET_BYTES = 4096
_BATCH_BYTES = 1 << 20
_BROADCAST_HASHES = 1_000_000


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position where it fits into the words."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    return mix(out)


def text_hashes(data: bytes | None) -> np.ndarray:
    """Hashes of a text's lower-cased words: letters a-z, digits, and all characters above ASCII."""
    lower = (data or b"").decode("utf-8", "replace").lower()
    return word_hashes(normalized(lower.encode()).split())


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(from, to, agreeing words) of the stretch with the highest score; the first of equal ones."""
    if not len(same):
        return 0, 0, 0
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, _DIFFERS))])
    lowest = np.minimum.accumulate(sums[:-1])
    b = int(np.argmax(sums[1:] - lowest)) + 1
    a = int(np.flatnonzero(sums[:b] == lowest[b - 1])[-1])
    return a, b, int(same[a:b].sum())


def _masks_for(n_words: int, masks: tuple[str, ...]) -> tuple[str, ...]:
    """An item with fewer words than the longest mask is looked for as a whole."""
    return masks if n_words >= max(map(len, masks)) else ("1" * n_words,) if n_words else ()


def _admitted(own: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Positions of the hashes of which both bits are set."""
    last, byte, bit = np.uint64(8 * len(bitmap) - 1), np.uint64(3), np.uint64(7)
    at = np.arange(len(own))
    for shift in (0, 32):
        place = (own[at] >> np.uint64(shift)) & last
        at = at[(bitmap[place >> byte] >> (place & bit).astype(np.uint8)) & 1 == 1]
    return at


def _runs(doc: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, hash, low, high): equal hashes at consecutive places of a text become one run, by text."""
    order = np.lexsort((at, hashes, doc))
    doc, hashes, at = doc[order], hashes[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return doc[first], hashes[first], at[first], at[last]


def _block_seeds(hashes: list[np.ndarray], masks: tuple[str, ...], whole: tuple[str, ...], bitmap: np.ndarray | None):
    """The seeds of many texts as runs. Of a mask in ``whole`` each text's first place is enough."""
    ends = np.cumsum([len(h) for h in hashes])
    joined = np.concatenate(hashes)
    found = []
    for mask in (*masks, *whole):
        own = seed_hashes(joined, mask)
        at = np.arange(len(own)) if bitmap is None else _admitted(own, bitmap)
        doc = np.searchsorted(ends, at, "right")
        inside = at + len(mask) <= ends[doc]
        at, doc = at[inside], doc[inside]
        own = own[at]
        if mask in whole:
            order = np.lexsort((at, own, doc))
            once = np.ones(len(order), bool)
            once[1:] = (doc[order][1:] != doc[order][:-1]) | (own[order][1:] != own[order][:-1])
            at, doc, own = (x[order][once] for x in (at, doc, own))
        found.append((doc, own, at - (ends - [len(h) for h in hashes])[doc]))
    return _runs(*(np.concatenate(x) for x in zip(*found))) if found else (np.empty(0, np.int64),) * 4


def _seeded(texts: DataFrame, masks: tuple[str, ...], whole: tuple[str, ...] = (), bitmap=None) -> DataFrame:
    """``SEEDED`` rows of (key, text); with a bitmap only texts with an admitted seed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bitmap is None else bitmap.value
        for batch in batches:
            keys, column, at = batch["key"], batch["text"].cast(pa.binary()), 0
            while at < len(column):
                hashes, size, start = [], 0, at
                while at < len(column) and (not hashes or size < _BATCH_BYTES):
                    data = column[at].as_py()
                    hashes.append(text_hashes(data))
                    size, at = size + len(data or b""), at + 1
                if known is None:  # items: each with the masks of its length
                    parts = [_block_seeds([h], _masks_for(len(h), masks), (), None) for h in hashes]
                    doc = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
                    _, own, low, high = (np.concatenate(x) for x in zip(*parts))
                    kept = np.arange(len(hashes))
                else:
                    doc, own, low, high = _block_seeds(hashes, masks, whole, known)
                    kept = np.unique(doc)
                offsets = np.append(np.searchsorted(doc, kept), len(doc)).astype(np.int32)
                columns = [own.astype(np.uint64).view(np.int64), low.astype(np.int64), high.astype(np.int64)]
                seeds = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_SEED))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(start, len(hashes)).take(pa.array(kept)), pa.array([hashes[k].tobytes() for k in kept], pa.binary()), pa.ListArray.from_arrays(offsets, seeds)],
                    ["key", "words", "seeds"],
                )

    return texts.mapInArrow(rows, SEEDED)


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Two bits per hash, in at most ``_BITMAP_BITS[1]`` bits (64 MB), built by tasks in parts of 4 KB."""
    fewest, most = _BITMAP_BITS
    bits = fewest
    n = seeds.count()
    while bits < min(64 * n, most):
        bits *= 2
    places = F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(bits - 1)) + 1 for s in (0, 32)])
    places = seeds.select(F.explode(places).alias("place"))
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    out = np.zeros(bits // 8, np.uint8)
    for part in parts.toLocalIterator():
        out[(part["part"] - 1) * _BUCKET_BYTES : part["part"] * _BUCKET_BYTES] = np.frombuffer(part["bits"], np.uint8)
    return out


def _hits(probes: DataFrame, targets: DataFrame, hot_rows: int) -> DataFrame:
    """Distinct (row, item_row, shift) of equal hashes; a hash with over ``hot_rows`` rows is dealt to several tasks."""
    counts = probes.groupBy("hash").count().where(F.col("count") > hot_rows)
    hot = materialize(counts.select("hash", F.ceil(F.col("count") / hot_rows).alias("parts")))
    hot = F.broadcast(hot) if hot.count() <= _BROADCAST_HASHES else hot
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    dealt = probes.join(hot, "hash", "left").withColumn("part", F.pmod(F.xxhash64("row", "low"), parts)).drop("parts")
    copies = targets.join(hot, "hash", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    shifts = F.sequence(F.col("low") - F.col("item_high"), F.col("high") - F.col("item_low"))
    return dealt.join(copies, ["hash", "part"]).select("row", "item_row", F.explode(shifts).alias("shift")).distinct()


def _verified(pairs: DataFrame, min_match: int) -> DataFrame:
    """The best stretch of each (…, shift, item_part, doc_part) with enough agreeing words."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, places = [], []
            for k, (low, shift, n, a, b) in enumerate(zip(*(batch[c].to_pylist() for c in ("from", "shift", "item_words", "item_part", "doc_part")))):
                start, end, matched = best_stretch(np.frombuffer(a, np.uint64) == np.frombuffer(b, np.uint64))
                if matched >= min(min_match, n):
                    kept.append(k)
                    places.append((start + low + shift, start + low, end - start, matched))
            same = [batch[c].take(pa.array(kept, pa.int64())) for c in ("key", "row", "item", "item_row", "item_words", "doc_words")]
            found = [pa.array(c, pa.int64()) for c in (zip(*places) if places else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([*same, *found], [c.split()[0] for c in OVERLAP.split(", ")])

    return pairs.mapInArrow(verify, OVERLAP)


def _overlaps(texts: DataFrame, items: DataFrame, masks: tuple[str, ...], min_match: int, hot_rows: int) -> DataFrame:
    """``OVERLAP`` rows, the best per row of ``texts`` (key, text) and row of ``items`` (key, text)."""
    spark = texts.sparkSession
    bound_batches(spark)
    known = _seeded(items, masks).withColumnsRenamed({"key": "item", "words": "item_text"})
    known = written(known.withColumn("item_row", F.monotonically_increasing_id()), "benchmark-seeds")
    targets = known.select("item_row", F.explode("seeds").alias("s")).select(
        "item_row", "s.hash", F.col("s.low").alias("item_low"), F.col("s.high").alias("item_high")
    )
    n_words = (F.length("item_text") / 8).cast("bigint")
    longest = max(map(len, masks))
    sizes = known.select(n_words.alias("n")).where((F.col("n") > 0) & (F.col("n") < longest)).distinct().collect()
    whole = tuple("1" * r["n"] for r in sizes)
    bitmap = spark.sparkContext.broadcast(_bitmap(targets.select("hash")))
    found = _seeded(texts, masks, whole, bitmap).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "document-seeds")
    probes = found.select("row", F.explode("seeds").alias("s")).select("row", "s.*")
    hits = _hits(probes, targets, hot_rows)
    sides = hits.join(known.select("item_row", "item", "item_text", n_words.alias("item_words")), "item_row").join(
        found.select("row", "key", "words", (F.length("words") / 8).cast("bigint").alias("doc_words")), "row"
    )
    low = F.greatest(F.lit(0), -F.col("shift"))
    size = F.least("item_words", F.col("doc_words") - F.col("shift")) - low

    def part(text: str, start: Column) -> Column:
        return F.col(text).substr((8 * start + 1).cast("int"), (8 * size).cast("int"))

    pairs = sides.select(
        "key", "row", "item", "item_row", "item_words", "doc_words", "shift", low.alias("from"),
        part("item_text", low).alias("item_part"), part("words", low + F.col("shift")).alias("doc_part"),
    )
    place = F.struct((-F.col("n_matched")).alias("order"), "doc_start", "item_start", "n_words", "n_matched")
    same = ["key", "row", "item", "item_row", "item_words", "doc_words"]
    return _verified(pairs, min_match).groupBy(*same).agg(F.min(place).alias("best")).select(*same, "best.*").drop("order")


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(f"`{id_col}`").cast("bigint").alias("key"), F.col(f"`{text_col}`").alias("text"))


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_match: int = 12,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(``id_col``, ``item_col``, doc_start, item_start, n_words, n_matched) of verified overlaps.

    A row per document and item with at least ``min_match`` agreeing words in
    one stretch (all words of an item with fewer); of several stretches that with most
    agreeing words, then the first. Null and empty texts and items overlap
    with nothing; an empty benchmark gives no rows. Repeated rows are judged
    each. Items with fewer words than the longest mask must stand there unchanged.
    """
    found = _overlaps(_keyed(docs, id_col, text_col), _keyed(benchmark, item_col, item_text), masks, min_match, hot_rows)
    return found.select(F.col("key").alias(id_col), F.col("item").alias(item_col), "doc_start", "item_start", "n_words", "n_matched")


def overlapping_rows(
    rows: DataFrame,
    row_col: str,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_match: int = 12,
) -> DataFrame:
    """(key) of the rows, numbered by ``row_col``, whose text has a verified overlap with an item.

    An item with fewer than ``SHORT_WORDS`` words counts only if it is the
    whole text: such words stand in many texts that are not contaminated.
    ``benchmark_overlaps`` lists them all the same.
    """
    found = _overlaps(_keyed(rows, row_col, text_col), _keyed(benchmark, item_col, item_text), masks, min_match, HOT_ROWS)
    return found.where((F.col("item_words") >= SHORT_WORDS) | (F.col("n_words") == F.col("doc_words"))).select("key").distinct()
