"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates.

Training takes a bounded sample of labelled rows (``max_rows``, by the hash of
their id), deals it over ``shards`` tasks, runs the per-coordinate updates in
each and averages the weights by feature. There are at most ``2**bits`` weights
and a bias, so they can be collected and broadcast whatever the corpus is.
Scoring is a sparse dot product per text and runs over all rows without a
shuffle.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrends.llm.shared_store import bound_batches
from geotrends.llm.words import mix, word_hashes

# Runs of letters and digits (any byte above ASCII counts as a letter) and runs of marks.
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_TWICE = np.uint64(0x5BD1E9955BD1E995)


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    max_rows: int = 20_000  # bound of the training sample
    shards: int = 4
    epochs: int = 4
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.001


def features(data: bytes | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- and 2-grams of the whole text with values of length 1; none for an empty text.

    All 2-grams of one word said twice are one feature: such words are seldom seen again.
    """
    h = word_hashes(_TOKEN.findall(data or b""))
    if not len(h):
        return np.empty(0, np.int64), np.empty(0)
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pairs[h[:-1] == h[1:]] = _TWICE
    slots = (np.concatenate([h, pairs]) >> np.uint64(64 - bits)).astype(np.int64)
    found, counts = np.unique(slots, return_counts=True)
    values = np.log1p(counts)
    return found, values / np.sqrt(values @ values)


class Learner:
    """Follow-the-regularised-leader state of one shard; the last slot is the bias."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros(2**settings.bits + 1)
        self.n = np.zeros(2**settings.bits + 1)

    def weights(self, slots) -> np.ndarray:
        z, n, s = self.z[slots], self.n[slots], self.s
        w = (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        slots, values = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(slots)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[slots] += g * g


def train(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", label: str = "label", key: str = "key") -> np.ndarray:
    """Weights from rows (key, text, label 0 or 1); rows with a null label or key are left out.

    Each shard holds the rows of its keys' hashes and learns them in one call; the
    weights are averaged over the shards that have rows. So the result depends on the
    rows alone, not on partitions or settings. Without any row all weights are 0. Repeated rows count as often as they
    stand in the sample.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.select(
        F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(label).cast("double").alias("label")
    ).where("key is not null and label is not null")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(settings.shards)).cast("int"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [features(data.as_py(), settings.bits) for data in batch["text"].cast(pa.binary())]
            packed = [pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in zip(zip(*each), ("<i4", "<f4"))]
            if packed:
                yield pa.RecordBatch.from_arrays([batch["shard"], batch["key"], batch["label"], *packed], ["shard", "key", "label", "slots", "values"])

    def fit(shard: pa.Table) -> pa.Table:
        examples = list(zip(*(shard[c].to_pylist() for c in ("key", "label", "slots", "values"))))
        examples.sort(key=lambda e: (mix(word_hashes([e[0].encode()]))[0], *e))
        examples = [(np.frombuffer(x, "<i4"), np.frombuffer(v, "<f4"), y) for _, y, x, v in examples]
        learner = Learner(settings)
        for _ in range(settings.epochs):
            for slots, values, y in examples:
                learner.learn(slots, values.astype(np.float64), y)
        w = learner.weights(slice(None))
        kept = np.flatnonzero(w)
        # Slot -1 counts the shards that learned.
        return pa.table({"slot": np.append(kept, -1), "weight": np.append(w[kept], 1.0)})

    # One call for each shard, wherever it lies: at most max_rows / shards rows or so.
    averaged = (
        rows.mapInArrow(extract, "shard int, key string, label double, slots binary, values binary")
        .groupBy("shard")
        .applyInArrow(fit, "slot bigint, weight double")
        .groupBy("slot")
        .agg(F.sort_array(F.collect_list("weight")).alias("each"))
        .select("slot", F.aggregate("each", F.lit(0.0), lambda a, w: a + w).alias("weight"))
        .toPandas()
    )
    weights = np.zeros(2**settings.bits + 1)
    learned = averaged["slot"].to_numpy(np.int64) >= 0
    if len(averaged):
        weights[averaged["slot"].to_numpy(np.int64)[learned]] = averaged["weight"].to_numpy()[learned] / averaged["weight"].to_numpy()[~learned][0]
    return weights


def training_sample(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings(), key: str = "doc_id") -> DataFrame:
    """(key, text, label) of at most ``max_rows`` labelled rows, chosen by the hash of their key.

    A key that several rows of ``docs`` share stands for the smallest of their texts.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(settings.max_rows)
    )
    # At most max_rows rows: the broadcast is bounded, and only their texts move.
    texts = docs.select(F.col(key).alias("key"), "text")
    return texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text"))


def score(text: Column | str, weights: np.ndarray, spark) -> Column:
    """Probability of label 1 for each text; empty and null texts get that of the bias."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for batch in batches:
            out = np.empty(len(batch))
            for i, data in enumerate(batch.cast(pa.binary())):
                slots, values = features(data.as_py(), bits)
                out[i] = w[slots] @ values + w[-1]
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return scored(text)
