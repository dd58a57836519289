"""Phrase collocations of whole corpora, counted in HAT-tries.

Phrases are counted level by level, so that only those are written whose parts
are frequent: first words, then pairs of frequent words, then phrases of three
and four words whose pairs are frequent. Within a task the phrases of a
language live in a trie over word ids with a few levels of 16-way nodes and
hash tables below; a table that grows too large bursts into a node. When a
task holds too many phrases, the largest subtree below the root is spilled: it
leaves the task as a sorted run of rows (language, prefix of up to three words,
last word, count). The runs are partitioned by prefix and merged there.

Which parts are frequent is told to the tasks by a bitmap of a fixed number of
bits, made where the counts are. A false bit only lets a rare phrase be
counted; its count then drops it. All counts are exact.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from geotrends.llm.shared_store import bound_batches, written
from geotrends.llm.words import BASES, mix

LONGEST = 4  # words of a phrase: their 16-bit ids make up a 64-bit key
_BITS = 26  # of the bitmap's size
_BUCKET = 32768  # bits of one row of the bitmap, as Spark's bitmap functions have it
_BURST = 4096  # phrases of a hash table
_HELD = 1_000_000  # phrases that a task holds
_MOST_WORDS = 500_000  # distinct words that a task remembers for a language
_COUNTED = "lang string, prefix string, last string, times bigint"
# One byte for each end of a piece, a blank for a tab.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)


def pieces_and_words(texts: list[bytes]) -> list[bytes]:
    """All words in order, with ``b"."`` between pieces."""
    return b".".join(texts).translate(_PLAIN).replace(b".", b" . ").split()


def _rows(lang: str, prefixes: pa.Array, last: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(prefixes), np.int32)), pa.array([lang])).dictionary_decode()
    texts = [x.cast(pa.string(), safe=False) for x in (prefixes, last)]
    return pa.RecordBatch.from_arrays([langs, *texts, pa.array(times, pa.int64())], ["lang", "prefix", "last", "times"])


class HatTrie:
    """Counts of 64-bit phrase keys. A leaf covers the keys from its start up to the next leaf's."""

    def __init__(self):
        self.starts, self.bits = np.zeros(1, np.uint64), [64]  # bits below the prefix of a leaf
        self.leaves: list[dict[int, int]] = [{}]
        self.size = 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        """``keys`` are sorted and distinct."""
        if not len(keys):
            return
        ends = np.append(np.searchsorted(keys, self.starts[1:]), len(keys)).tolist()
        listed, counted, start, full = keys.tolist(), times.tolist(), 0, []
        for at, end in enumerate(ends):
            if start < end:
                leaf = self.leaves[at]
                before, get = len(leaf), leaf.get
                for key, n in zip(listed[start:end], counted[start:end]):
                    leaf[key] = get(key, 0) + n
                self.size += len(leaf) - before
                if len(leaf) > _BURST:
                    full.append(at)
            start = end
        for at in reversed(full):
            self._burst(at)

    def _burst(self, at: int) -> None:
        """Turn a hash table into a node of 16 tables; down to a single key if need be."""
        leaf, bits, first = self.leaves[at], self.bits[at], int(self.starts[at])
        if len(leaf) <= _BURST or bits <= 4:
            return
        children: list[dict[int, int]] = [{} for _ in range(16)]
        shift = bits - 4
        for key, n in leaf.items():
            children[(key >> shift) & 15][key] = n
        starts = np.array([first + (i << shift) for i in range(16)], np.uint64)
        self.starts = np.concatenate([self.starts[:at], starts, self.starts[at + 1 :]])
        self.leaves[at : at + 1], self.bits[at : at + 1] = children, [shift] * 16
        for i in range(15, -1, -1):
            self._burst(at + i)

    def spill(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the largest subtree below the root, sorted; it is empty afterwards."""
        tops = (self.starts >> np.uint64(60)).astype(int)
        sizes = np.bincount(tops, [len(x) for x in self.leaves], 16)
        which = np.flatnonzero(tops == sizes.argmax()) if len(self.leaves) > 1 else np.array([0])
        size = sum(len(self.leaves[at]) for at in which)
        keys = np.fromiter(chain.from_iterable(self.leaves[at] for at in which), np.uint64, size)
        times = np.fromiter(chain.from_iterable(self.leaves[at].values() for at in which), np.int64, size)
        for at in which:
            self.leaves[at] = {}
        self.size -= size
        order = np.argsort(keys)
        return keys[order], times[order]


def _reversed16(n: np.ndarray) -> np.ndarray:
    """The 16 bits of each number back to front: numbers given in order fill all subtrees alike."""
    n = ((n & 0x5555) << 1) | ((n >> 1) & 0x5555)
    n = ((n & 0x3333) << 2) | ((n >> 2) & 0x3333)
    n = ((n & 0x0F0F) << 4) | ((n >> 4) & 0x0F0F)
    return ((n & 0x00FF) << 8) | (n >> 8)


def lang_salt(lang: str) -> int:
    return xxh3_64_intdigest(lang.encode())


def _positions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the bitmap for each phrase hash."""
    return (h >> np.uint64(64 - _BITS)).astype(np.int64), (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(BASES[0]) + h[1:])


class _Known(dict):
    """Numbers of frequent words from 1 on; 0 for others and for the end of a piece."""

    def __init__(self, lang: str, frequent: bytes):
        self.salt, self.frequent = lang_salt(lang), frequent
        self.words: list[bytes] = [b""]
        self.hashes: list[int] = [0]
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        h, number = xxh3_64_intdigest(word, self.salt), 0
        a, b = h >> (64 - _BITS), h & ((1 << _BITS) - 1)
        if self.frequent[a >> 3] >> (a & 7) & self.frequent[b >> 3] >> (b & 7) & 1:
            number = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
        self[word] = number
        return number


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _positions(h)
    return ((bitmap[a >> 3] >> (a & 7)) & (bitmap[b >> 3] >> (b & 7)) & 1).astype(bool)


class _Phrases:
    """The phrases of one language in a task."""

    def __init__(self, lang: str, frequent: bytes, pairs: np.ndarray | None):
        self.lang, self.frequent, self.pairs = lang, frequent, pairs
        self.known, self.trie = _Known(lang, frequent), HatTrie()

    def add(self, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        words = pieces_and_words(texts)
        for at in range(0, len(words), 50_000):
            # Phrases that begin in this part; at most so many words are new in it.
            part = words[at : at + 50_000 + LONGEST - 1]
            if len(self.known.words) + len(part) > 0xFFFF or len(self.known) > _MOST_WORDS:
                fresh = len(set(part) - self.known.keys())
                if len(self.known.words) + fresh > 0xFFFF or len(self.known) > _MOST_WORDS:
                    yield from self.drain()
                    self.known = _Known(self.lang, self.frequent)
            self._count(np.fromiter(map(self.known.__getitem__, part), np.int64, len(part)), 50_000)

    def _count(self, numbers: np.ndarray, begin: int) -> None:
        if self.pairs is None:
            live = (numbers[:-1] > 0) & (numbers[1:] > 0)
            sizes = {2: live}
        else:
            live = (numbers[:-1] > 0) & (numbers[1:] > 0)
            at = np.flatnonzero(live)
            h = np.array(self.known.hashes, np.uint64)[numbers]
            live[at] = _holds(self.pairs, mix(h[at] * np.uint64(BASES[0]) + h[at + 1]))
            three = live[:-1] & live[1:]
            sizes = {3: three, 4: three[:-1] & three[1:]}
        ids = _reversed16(numbers).astype(np.uint64)
        keys = []
        for size, mask in sizes.items():
            at = np.flatnonzero(mask[:begin])
            key = np.zeros(len(at), np.uint64)
            for k in range(size):
                key |= ids[at + k] << np.uint64(48 - 16 * k)
            keys.append(key)
        self.trie.add(*np.unique(np.concatenate(keys), return_counts=True))

    def spill(self) -> Iterator[pa.RecordBatch]:
        """A run of rows: of pairs the prefix is all, of longer phrases the first three words."""
        keys, times = self.trie.spill()
        words = pa.array(self.known.words, pa.binary())
        shown = 2 if self.pairs is None else 3
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            ids = [_reversed16(((part >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)).astype(np.int64)) for k in range(LONGEST)]
            prefixes = pc.binary_join_element_wise(*[words.take(pa.array(x)) for x in ids[:shown]], b" ")
            last = words.take(pa.array(ids[3], mask=ids[3] == 0))
            yield _rows(self.lang, prefixes, last, times[at : at + 50_000])

    def drain(self) -> Iterator[pa.RecordBatch]:
        while self.trie.size:
            yield from self.spill()


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
        texts.setdefault(lang, []).append(text)
    return texts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and one row without a word for all of a language."""
    held: dict[str, Counter] = {}

    def drained():
        for lang, counts in held.items():
            counts.pop(b".", None)
            ordered = sorted(counts)
            words = pa.array([*ordered, None], pa.binary())
            yield _rows(lang, words, pa.nulls(len(words), pa.binary()), np.array([*map(counts.get, ordered), counts.total()]))
        held.clear()

    for batch in batches:
        for lang, texts in _by_lang(batch).items():
            held.setdefault(lang, Counter()).update(pieces_and_words(texts))
        if sum(map(len, held.values())) > _HELD or len(held) > 1000:
            yield from drained()
    yield from drained()


def _merged(runs: DataFrame, least: int, kind: str) -> DataFrame:
    """Sums per (lang, phrase) of at least ``least``; rows without a phrase stay.

    The runs meet in partitions by the prefixes of their phrases.
    """
    summed = runs.repartition("lang", "prefix").groupBy("lang", "prefix", "last").agg(F.sum("times").alias("times"))
    frequent = summed.where(F.col("prefix").isNull() | (F.col("times") >= least))
    phrase = F.when(F.col("last").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit(" "), "last"))
    return written(frequent.select("lang", phrase.alias("phrase"), "times"), kind)


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """A bitmap of ``2**_BITS`` bits of the frequent words or pairs: 8 MB, whatever their number."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].cast(pa.binary()).to_pylist()):
                salt = lang_salt(lang)
                h = np.array([xxh3_64_intdigest(w, salt) for w in phrase.split(b" ")], np.uint64)
                out += [_pair_hashes(h) if len(h) > 1 else h]
            if out:
                bits = np.concatenate(_positions(np.concatenate(out)))
                columns = [pa.array(bits // _BUCKET, pa.int64()), pa.array(bits % _BUCKET, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "bit"])

    rows = frequent.select("lang", "phrase").mapInArrow(positions, "bucket bigint, bit bigint")
    bitmap = np.zeros((1 << _BITS) // 8, np.uint8)
    for row in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        at = row["bucket"] * _BUCKET // 8
        bitmap[at : at + _BUCKET // 8] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def frequent_phrases(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, times): all phrases of 1 to 4 words that occur ``least`` times or more in their language,
    and a row with a null phrase that counts all words of a language."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    words = _merged(texts.mapInArrow(_count_words, _COUNTED), least, "frequent-words")

    def counted(frequent, pairs) -> DataFrame:
        shared = spark.sparkContext.broadcast((frequent, pairs))  # 8 MB each

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, _Phrases] = {}
            for batch in batches:
                for lang, texts in _by_lang(batch).items():
                    if lang not in held:
                        held[lang] = _Phrases(lang, *shared.value)
                    yield from held[lang].add(texts)
                while sum(p.trie.size for p in held.values()) > _HELD:
                    yield from max(held.values(), key=lambda p: p.trie.size).spill()
                if len(held) > 100:
                    for phrases in held.values():
                        yield from phrases.drain()
                    held.clear()
            for phrases in held.values():
                yield from phrases.drain()

        return texts.mapInArrow(count, _COUNTED)

    frequent = _bitmap(words.where("phrase is not null")).tobytes()
    pairs = _merged(counted(frequent, None), least, "frequent-pairs")
    longer = _merged(counted(frequent, _bitmap(pairs)), least, "frequent-phrases")
    return words.unionByName(pairs).unionByName(longer)


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, least: int = 30, inside_percent: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 4 words of each language.

    A text is lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and a
    piece into words at blanks and tabs. ``a`` counts all places of a phrase
    within pieces, ``n`` all words of the language. A phrase is cut in two where
    ``2,000,000 a / (l + r)``, rounded down, is least (first such cut), ``l`` and ``r``
    counting the two parts. A phrase that lies in a longer one with at least
    ``inside_percent`` of its places is left out. Ties in rank go by ``a``, then by the
    phrase's bytes. A null language is ``und``; null and empty texts hold no words;
    repeated rows count each; an empty table gives no rows. Other columns are
    not read.
    """
    all_counts = frequent_phrases(docs, least, text_col, lang_col)
    counts = all_counts.where("phrase is not null")
    words = F.split("phrase", " ")
    phrases = counts.select("lang", "phrase", F.col("times").alias("a"), words.alias("w"), F.size(words).alias("m")).where("m > 1")
    part = lambda first, size: F.concat_ws(" ", F.slice("w", first, size))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("right")
    )
    named = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("times").alias(name))
    scored = cuts.join(named("left", "l"), ["lang", "left"]).join(named("right", "r"), ["lang", "right"])
    whole = (_exact("a") * F.lit(2_000_000).cast("decimal(7,0)")).cast("decimal(30,0)")
    below = (_exact("l") + _exact("r")).cast("decimal(21,0)")
    scored = scored.withColumn("score", F.call_function("div", whole, below))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    size = F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size")
    inner = (
        phrases.where("m > 2")
        .select("lang", "w", "m", F.col("a").alias("longer"), size)
        .select("*", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("at"))
        .select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "longer")
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    covered = F.coalesce(_exact("longer") * 100 >= _exact("a") * inside_percent, F.lit(False))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "a", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = all_counts.where("phrase is null").select("lang", F.col("times").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score")
    )
