"""Near-duplicates by bottom-k sketches from one hash function.

1. Every text becomes the set of its shingles' hashes; equal sets are one class
   from here on, by two 64-bit sums over the set.
2. The ``k`` smallest hashes of a set are its sketch. Values that two sketches
   retain make inverted lists. A pair as similar as asked shares at least a
   share ``least`` of its sketch (lost with a chance below 10^-6), so it already
   meets among the rarest values: only those are kept (a prefix filter), and
   a passage that a third of all texts share does not pair them.
3. In each list the members are compared to one pivot, the one whose values are
   the most common, so a list of any length makes one pair per member. The
   union of the two sketches estimates the similarity and filters.
4. Pairs are verified by the exact similarity of their whole sets, and linked
   texts form components.
5. Lists whose members are not all in one component by then go to an exact join
   of whole sets: rarest shingles first, with the bound on the overlap that the
   place of a common shingle leaves. What that finds is verified likewise, and so no
   link between components is lost to the pivots.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrends.llm.components import connected_components
from geotrends.llm.shared_store import bound_batches, written
from geotrends.llm.words import lower_words, mix, text_bytes, windows, word_hashes
from geotrends.session import materialize

SKETCH = "key bigint, n bigint, one bigint, two bigint, sketch array<bigint>"
SETS = "key bigint, shingles array<bigint>"
# Ids that may be broadcast: 8 MB.
_BROADCAST_IDS = 1_000_000


def shingles(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, none without words."""
    h = word_hashes(lower_words(data))
    return np.unique(windows(h, min(size, len(h))).view(np.int64)) if len(h) else np.empty(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _blocks(batch: pa.RecordBatch, rows: int = 500) -> Iterator[tuple[pa.Array, list]]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part["key"], text_bytes(part["text"])


def sketches(texts: DataFrame, size: int, k: int) -> DataFrame:
    """(key, n, one, two, sketch) of (key, text): set size, the set's two sums, its k smallest hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, data in _blocks(batch):
                sets = [shingles(x, size) for x in data]
                sums = [(int(mix(s.view(np.uint64) ^ np.uint64(seed)).sum()) & (1 << 64) - 1) for s in sets for seed in (1, 2)]
                sums = np.array(sums, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0::2]), pa.array(sums[1::2]), _lists([s[:k] for s in sets])],
                    ["key", "n", "one", "two", "sketch"],
                )

    return texts.mapInArrow(sketch, SKETCH)


def whole_sets(texts: DataFrame, size: int) -> DataFrame:
    """(key, shingles) of (key, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, data in _blocks(batch):
                yield pa.RecordBatch.from_arrays([keys, _lists([shingles(x, size) for x in data])], ["key", "shingles"])

    return texts.mapInArrow(sets, SETS)


def of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose key is in the stored frame ``ids`` (key); a short list is broadcast, so texts stay in place."""
    few = ids.count() <= _BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "key", "left_semi")


def without_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose id is not in the stored frame ``ids`` (key); a short list is broadcast, rows with a null id stay."""
    few = ids.count() <= _BROADCAST_IDS
    dropped = "_dropped_id"
    while dropped in rows.columns:
        dropped += "_"
    ids = ids.select(F.col("key").alias(dropped))
    return rows.join(F.broadcast(ids) if few else ids, F.col(f"`{id_col}`") == F.col(dropped), "left_anti")


def estimated(a: Column, b: Column, k: int) -> Column:
    """Estimate of the similarity from the k smallest values of the union of two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def _distinct_pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, k: int, least: float, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are as similar as asked; sketches filter first."""
    sketch = classes.select("key", "sketch")
    likely = (
        pairs.join(sketch.toDF("a", "sa"), "a")
        .join(sketch.toDF("b", "sb"), "b")
        .where(estimated(F.col("sa"), F.col("sb"), k) >= least)
        .select("a", "b")
    )
    likely = materialize(likely)
    ids = materialize(likely.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    sets = whole_sets(of_ids(texts, ids), size)
    both = F.size(F.array_intersect("xa", "xb"))
    return (
        likely.join(sets.toDF("a", "xa"), "a")
        .join(sets.toDF("b", "xb"), "b")
        .where(100 * both >= percent * (F.size("xa") + F.size("xb") - both))
        .select("a", "b")
        .distinct()
    )


def _rare_lists(classes: DataFrame, least: float) -> DataFrame:
    """(value, key, common) of each class's rarest retained values that another class retains too.

    ``common`` is how common the values of the class's sketch are, to choose pivots by.
    """
    values = classes.select("key", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = values.join(counts, "value").groupBy("key", "m").agg(
        F.sort_array(F.collect_list(F.struct("times", "value"))).alias("shared"), F.sum("times").alias("common")
    )  # at most k values in a row
    # Values of one class alone are rarer than all in ``shared`` and use up their part of the prefix.
    prefix = F.col("m") - F.ceil(F.col("m") * least) + 1 - (F.col("m") - F.size("shared"))
    return (
        shared.where(prefix > 0)
        .select("key", "common", F.explode(F.slice("shared", 1, prefix.cast("int"))).alias("s"))
        .select(F.col("s.value").alias("value"), "key", "common")
    )


def _bounded_join(sets: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that the places of their common shingles do not rule out.

    Shingles are ordered by how many sets have them. The first shingle that two
    sets share, at places p and q, leaves an overlap of at most
    1 + min(|x| - p, |y| - q); it lies within the first |x| - ceil(s |x|) + 1 places of each.
    """
    tokens = sets.join(components, "key").select("key", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
    counts = tokens.groupBy("value").agg(F.count(F.lit(1)).alias("times"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    counts = counts.where("times > 1")
    shared = tokens.join(counts, "value")
    row = Window.partitionBy("key", "n").orderBy("times", "value")
    # Shingles of one set alone come first, whatever their number: n minus the shared ones.
    placed = shared.withColumn("among", F.count(F.lit(1)).over(Window.partitionBy("key", "n"))).withColumn(
        "place", F.col("n") - F.col("among") + F.row_number().over(row)
    )
    prefix = materialize(
        placed.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("c0") != F.col("c1")))
        .select("value", "key", "comp", "n", "place")
    )
    x, y = prefix.alias("x"), prefix.alias("y")
    overlap = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    possible = overlap * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    return (
        x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.comp") < F.col("y.comp")) & possible)
        .select(*_distinct_pairs(F.col("x.key"), F.col("y.key")))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 75,
    k: int = 40,
    least: float = 0.4,
) -> DataFrame:
    """(``id_col``, n_shingles, component_id, kept), a row per document.

    Shingles are ``size`` consecutive words ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased. Documents are linked if 100 * intersection >= percent *
    union; a component is named by its smallest id, and that document is kept.
    Null and empty texts have no shingles, are linked with nothing and kept.
    Rows that repeat an id with other words are classes of their own, which
    may share a name; equal rows get equal results.
    A null id joins a component but never names one that has another id.
    Other columns are left out.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("key"), F.col(f"`{text_col}`").alias("text"))
    rows = written(sketches(texts, size, k), "sketches")
    same = ["n", "one", "two"]
    groups = rows.where("n > 0").groupBy(*same).agg(F.min("key").alias("first"), F.first("sketch").alias("sketch"))
    groups = written(groups, "classes")
    classes = groups.where("first is not null").select(F.col("first").alias("key"), "sketch")
    lists = materialize(_rare_lists(classes, least))
    pivots = lists.groupBy("value").agg(F.max_by("key", F.struct("common", -F.col("key"))).alias("pivot"))
    pairs = lists.join(pivots, "value").where("key <> pivot").select(*_distinct_pairs(F.col("key"), F.col("pivot"))).distinct()
    links = materialize(verified(pairs, classes, texts, size, k, least, percent))
    found = connected_components(links)

    named = lists.join(found.toDF("key", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    named = materialize(named.select("value", "key", "comp"))
    open_lists = named.groupBy("value").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    unsettled = materialize(named.join(open_lists.select("value"), "value", "left_semi").select("key", "comp").distinct())
    sets = whole_sets(of_ids(texts, unsettled.select("key")), size)
    missed = verified(_bounded_join(sets, unsettled, percent), classes, texts, size, k, least, percent)
    every = connected_components(links.unionByName(missed))

    named_groups = groups.select(*same, "first").join(every.toDF("first", "component"), "first", "left")
    named_groups = named_groups.select(*same, F.coalesce("component", "first").alias("component"))
    out = rows.select("key", *same).join(named_groups, same, "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "key")).otherwise(F.col("key"))
    out = out.select("key", "n", component.alias("component_id"))
    return out.select(
        F.col("key").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("key").eqNullSafe(F.col("component_id")).alias("kept"),
    )
