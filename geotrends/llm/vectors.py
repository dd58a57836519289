"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves and each half has its own codebook, fitted on
a bounded sample; a vector lies in the cell of its two nearest codewords. From
a vector the cells are visited in the order of the summed distances of the two
halves (multi-sequence traversal). How many are visited is measured on links of
the data themselves: a bounded number of sampled vectors is compared with all
vectors of their label, and the wanted share of the links found so must be met
from one side or the other in every band of cosines, the one next to the
threshold as well as all together; likewise the wanted share of synthetic
neighbours in random directions. Vectors met in visited cells are verified by
their cosine in double precision.

Equal vectors are one class from the start, so a vector that makes up a third of the
rows is compared once. Crowded cells and crowds of visitors are cut into
blocks, and a task compares one block with another: no task holds a whole cell
or label. Vectors of different labels or lengths never meet.
"""

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.llm.components import connected_components
from geotrends.llm.shared_store import written
from geotrends.session import materialize

CLEAN = "key bigint, label string, dim int, digest binary, vec binary"
VISIT = "label string, dim int, cell bigint, key bigint, vec binary"
CELL = ["label", "dim", "cell"]


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    recall: float = 0.99  # of the links measured, in each band of cosines
    sample: int = 4096  # bound of the sample the index is fitted on
    queries: int = 1024  # bound of the sampled vectors compared with all of their label
    bands: int = 4  # of cosines from the threshold to 1
    cell_size: int = 32  # vectors of one label that a cell should hold
    max_words: int = 64  # of a codebook
    members: int = 2048  # vectors of a cell in one block
    visitors: int = 8192  # visitors of a cell in one block


@dataclass
class Index:
    """Two codebooks and the number of cells to visit, for vectors of one length."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = unit.shape[1] // 2
        return _squared(unit[:, :half], self.first), _squared(unit[:, half:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * len(self.second) + b.argmin(1)


def _squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)


def nearest_cells(a: np.ndarray, b: np.ndarray, count: int) -> list[int]:
    """The ``count`` cells with the smallest sums a[i] + b[j], in order (multi-sequence traversal)."""
    i_of, j_of = a.argsort(kind="stable"), b.argsort(kind="stable")
    sa, sb = a[i_of].tolist(), b[j_of].tolist()
    heap, out = [(sa[0] + sb[0], 0, 0)], []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append(int(i_of[i]) * len(sb) + int(j_of[j]))
        # Each cell is pushed once: along j from every row, to the next row from its first column.
        if j + 1 < len(sb):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def unit_vectors(packed: list[bytes], dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.float64).reshape(-1, dim)
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def codebook(x: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly chosen rows; a word that loses all its rows stays where it is."""
    centers = x[np.linspace(0, len(x) - 1, min(words, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _squared(x, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=len(centers))
        centers[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centers


def fit(unit: np.ndarray, per_label: float, s: Settings) -> Index:
    """An index from sampled unit vectors of one length; ``per_label``: how many vectors a label has.

    ``visits`` is what neighbours in random directions need; those of the data may need more.
    """
    half, words = unit.shape[1] // 2, int(np.clip(np.sqrt(per_label / s.cell_size), 1, s.max_words))
    index = Index(codebook(unit[:, :half], words), codebook(unit[:, half:], words), 1)
    random = np.random.default_rng(0)
    own = unit[random.integers(0, len(unit), 1000)]
    noise = random.normal(size=own.shape)
    noise -= (noise * own).sum(1, keepdims=True) * own
    size = np.sqrt((noise * noise).sum(1, keepdims=True))
    other = s.threshold * own + np.sqrt(max(0.0, 1 - s.threshold**2)) * noise / np.where(size > 0, size, 1)
    places = np.minimum(_place(index, own, index.cells(other)), _place(index, other, index.cells(own)))
    index.visits = _enough(*np.unique(places, return_counts=True), s.recall)
    return index


def _enough(places: np.ndarray, times: np.ndarray, recall: float) -> int:
    """Visits that meet the share ``recall`` of the links at these places (in order), each seen ``times`` times."""
    seen = np.cumsum(times)
    return int(places[np.searchsorted(seen, np.ceil(recall * seen[-1]))]) + 1


def _place(index: Index, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many cells are nearer to each vector than the given one."""
    a, b = index.distances(unit)
    sums = (a[:, :, None] + b[:, None, :]).reshape(len(unit), -1)
    return (sums < sums[np.arange(len(unit)), cells][:, None]).sum(1)


def _ranks(index: Index, unit: np.ndarray) -> np.ndarray:
    """The place of every cell in each vector's order of cells."""
    a, b = index.distances(unit)
    order = (a[:, :, None] + b[:, None, :]).reshape(len(unit), len(a[0]) * len(b[0])).argsort(1, kind="stable")
    out = np.empty(order.shape, np.uint16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint16)[None], 1)
    return out


def clean_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(key, label, dim, digest, vec) of every row; ``vec`` is packed doubles, and with ``digest`` null where nothing can be linked."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    usable = (
        F.col("label").isNotNull()
        & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    all_rows = rows.select(
        F.col(f"`{id_col}`").cast("bigint").alias("key"), F.col(f"`{label_col}`").cast("string").alias("label"), vec.alias("v")
    ).select("key", "label", F.when(usable, F.col("v")).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if v is None else (np.array(v, np.float64) + 0.0).tobytes() for v in batch["v"].to_pylist()]
            digests = [None if p is None else hashlib.blake2b(p, digest_size=16).digest() for p in packed]
            dims = [None if p is None else len(p) // 8 for p in packed]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["label"], pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())],
                ["key", "label", "dim", "digest", "vec"],
            )

    return all_rows.mapInArrow(pack, CLEAN)


def fit_indexes(classes: DataFrame, s: Settings) -> dict[int, Index]:
    """An index for each vector length in a sample of at most ``sample`` classes.

    Lengths that the sample does not hold get no index; their vectors share one cell.
    """
    counts = classes.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    sample = classes.orderBy(F.xxhash64("digest"), "key").limit(s.sample).select("label", "dim", "vec").toPandas()
    out, queries = {}, {}
    for dim, group in sample.groupby("dim"):
        if dim > 1:
            unit = unit_vectors([bytes(v) for v in group["vec"]], int(dim))
            out[int(dim)] = fit(unit, counts["n"] / max(1, counts["labels"]), s)
    # Rows of the sample are in the order of their hashes: the first ones are a sample too.
    for (dim, label), group in sample.head(s.queries).groupby(["dim", "label"]):
        if dim in out:
            queries[int(dim), label] = unit_vectors([bytes(v) for v in group["vec"]], int(dim))
    places = link_places(classes, out, queries, s).toPandas().sort_values("place")
    for dim, group in places.groupby("dim"):
        for links in [group.groupby("place", as_index=False)["times"].sum(), *(g for _, g in group.groupby("band"))]:
            visits = _enough(links["place"].to_numpy(), links["times"].to_numpy(), s.recall)
            out[dim].visits = max(out[dim].visits, visits)
    return out


def link_places(classes: DataFrame, indexes: dict[int, Index], queries: dict[tuple[int, str], np.ndarray], s: Settings) -> DataFrame:
    """(dim, band, place, times): how many cells are nearer than a linked vector's, for all links of the queries.

    ``queries`` holds unit vectors by length and label. All vectors are read
    where they lie; only the counts move, at most one row per band and cell.
    """
    places_of = {at: (x, indexes[at[0]].cells(x), _ranks(indexes[at[0]], x)) for at, x in queries.items()}
    # Bounded by the number of queries and the codebook size.
    shared = classes.sparkSession.sparkContext.broadcast((indexes, places_of))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, queries = shared.value
        times = {dim: np.zeros((s.bands, len(x.first) * len(x.second)), np.int64) for dim, x in indexes.items()}
        for batch in batches:
            which: dict[tuple, list] = {}
            for i, at in enumerate(zip(batch["dim"].to_pylist(), batch["label"].to_pylist())):
                if at in queries:
                    which.setdefault(at, []).append(i)
            packed = batch["vec"].to_pylist() if which else []
            for at, rows in which.items():
                index, (own, cells, ranks) = indexes[at[0]], queries[at]
                for k in range(0, len(rows), 256):
                    unit = unit_vectors([packed[i] for i in rows[k : k + 256]], at[0])
                    cosines = unit @ own.T
                    # A query meets itself as well; that is no link.
                    i, j = np.nonzero((cosines >= s.threshold) & (cosines < 1 - 1e-12))
                    if not len(i):
                        continue
                    met, row = np.unique(i, return_inverse=True)
                    x = unit[met]
                    place = np.minimum(_ranks(index, x)[row, cells[j]], ranks[j, index.cells(x)[row]])
                    band = (cosines[i, j] - s.threshold) / max(1 - s.threshold, 1e-12) * s.bands
                    np.add.at(times[at[0]], (np.minimum(band.astype(int), s.bands - 1), place), 1)
        for dim, found in times.items():
            band, place = np.nonzero(found)
            columns = (np.full(len(band), dim), band, place, found[band, place])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "band", "place", "times"])

    seen = classes.select("label", "dim", "vec").mapInArrow(places, "dim bigint, band bigint, place bigint, times bigint")
    return seen.groupBy("dim", "band", "place").agg(F.sum("times").alias("times"))


def visited(classes: DataFrame, indexes: dict[int, Index], home: bool) -> DataFrame:
    """A row per vector and cell: its own cell if ``home``, else each cell it visits."""
    shared = classes.sparkSession.sparkContext.broadcast(indexes)  # bounded by the codebook size per length

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                dims, packed = part["dim"].to_numpy(), part["vec"].to_pylist()
                row, cell = [], []
                for dim in np.unique(dims).tolist():
                    which = np.flatnonzero(dims == dim)
                    index = shared.value.get(dim)
                    if index is None:
                        row, cell = row + which.tolist(), cell + [0] * len(which)
                        continue
                    unit = unit_vectors([packed[i] for i in which], dim)
                    if home:
                        row, cell = row + which.tolist(), cell + index.cells(unit).tolist()
                        continue
                    for i, a, b in zip(which.tolist(), *index.distances(unit)):
                        near = nearest_cells(a, b, index.visits)
                        row, cell = row + [i] * len(near), cell + near
                take = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [take["label"], take["dim"], pa.array(cell, pa.int64()), take["key"], take["vec"]], [*CELL, "key", "vec"]
                )

    return classes.mapInArrow(cells, VISIT)


def linked_pairs(classes: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of classes of one label with a cosine of at least the threshold."""
    indexes = fit_indexes(classes, s)
    members, visits = visited(classes, indexes, True), visited(classes, indexes, False)
    sizes = members.groupBy(*CELL).agg(F.count(F.lit(1)).alias("m")).join(
        visits.groupBy(*CELL).agg(F.count(F.lit(1)).alias("v")), CELL
    )
    sizes = materialize(
        sizes.select(*CELL, F.ceil(F.col("m") / s.members).cast("int").alias("mb"), F.ceil(F.col("v") / s.visitors).cast("int").alias("vb"))
    )
    grid = [*CELL, "mi", "vi"]
    salt = lambda n: F.pmod(F.xxhash64("key", "vec"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(sizes, CELL).withColumn("mi", salt("mb")).withColumn("vi", every("vb")).select(*grid, "key", "vec")
    right = visits.join(sizes, CELL).withColumn("vi", salt("vb")).withColumn("mi", every("mb")).select(*grid, "key", "vec")

    def compare(member: pd.DataFrame, visitor: pd.DataFrame) -> pd.DataFrame:
        if member.empty or visitor.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        dim = int(member["dim"].iloc[0])
        x, y = (unit_vectors([bytes(v) for v in t["vec"]], dim) for t in (member, visitor))
        kx, ky = member["key"].to_numpy(), visitor["key"].to_numpy()
        out = []
        for at in range(0, len(y), 1024):
            j, i = np.nonzero(y[at : at + 1024] @ x.T >= s.threshold)
            out.append(np.stack([kx[i], ky[at + j]], 1))
        pairs = np.concatenate(out)
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(compare, "a bigint, b bigint")
    return found.distinct()


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    settings: Settings = Settings(),
) -> DataFrame:
    """(``id_col``, n_links, component_id, kept), a row per vector.

    Vectors of one label and length are linked if their cosine is at least the
    threshold; ``n_links`` counts the other vectors linked directly, copies
    included. A vector that is null, empty, zero or holds a null or non-finite
    number, or has no label, links with nothing. Found links are exact; the share of links
    found is about ``recall`` or more. Rows that repeat an id are vectors of their
    own, and so are rows without one; ``component_id`` is the smallest id of the
    component, null if it has none. Other columns are left out.
    """
    every = written(clean_vectors(rows, id_col, vec_col, label_col), "vectors")
    same = ["label", "digest"]
    # Equal vectors are a class with a number of its own; ids come back at the end.
    groups = written(
        every.where("digest is not null").groupBy(*same, "dim").agg(
            F.min("key").alias("first_id"), F.count(F.lit(1)).alias("times"), F.first("vec").alias("vec")
        ).withColumn("key", F.monotonically_increasing_id()), "vector-classes",
    )
    links = materialize(linked_pairs(groups.select("key", "label", "dim", "digest", "vec"), settings))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    times = groups.select(F.col("key").alias("b"), "times")
    near = both.join(times, "b").groupBy("a").agg(F.sum("times").alias("others"))
    found = connected_components(links).select(F.col("node").alias("key"), "component")
    classes = (
        groups.select(*same, "key", "times", "first_id")
        .join(near.select(F.col("a").alias("key"), "others"), "key", "left")
        .join(found, "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    smallest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = classes.join(smallest, "component").select(
        *same, "component_id", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    )
    out = every.select("key", *same).join(named, same, "left")
    component = F.when(F.col("links").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("key").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )
