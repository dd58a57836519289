import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from geotrends.llm.q_quality import op7_quality, quality_scores
from geotrends.llm.quality import Settings, features, score, train, training_sample


def _labelled(spark):
    good = ["the river runs along the old town and the hills"] * 20 + ["a letter from the town arrived in the evening"] * 20
    bad = ["BUY!! NOW!! CHEAP!! the offer!!"] * 20 + ["word word word word other other other other"] * 20
    rows = [(f"k{i}", f"{t} {i}", y) for y, ts in ((1, good), (0, bad)) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows + [(None, "x", 1), ("z", "x", None), ("n", None, 1)], "key string, text string, label int")


def test_training_does_not_depend_on_partitions(spark):
    rows = _labelled(spark)
    plain = brute.follow_the_regularised_leader(
        [(r["key"], r["text"], r["label"]) for r in rows.collect() if r["key"] and r["label"] is not None], Settings()
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for parts in (4, 7, 211):
            for adaptive in ("true", "false"):
                spark.conf.set("spark.sql.shuffle.partitions", parts)
                spark.conf.set("spark.sql.adaptive.enabled", adaptive)
                weights = train(rows.repartition(3))
                assert np.allclose(weights, plain, rtol=1e-9, atol=1e-12) and np.any(weights)
                assert np.array_equal(weights, train(rows.coalesce(1)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert not np.any(train(rows.limit(0)))
    few = rows.where("key = 'k1'")  # one shard learns, the others have no rows
    assert np.allclose(train(few), train(few, Settings(shards=1)))


def test_scores(spark, make_docs):
    weights = train(_labelled(spark), Settings(shards=1))
    texts = ["the town in the evening", "NOW!! CHEAP!! offer!!", "unseen unseen unseen unseen unseen", None, "", "a " * 50_000]
    out = {r["doc_id"]: r["s"] for r in make_docs(texts).withColumn("s", score("text", weights, spark)).select("doc_id", "s").collect()}
    assert out[0] > 0.5 > out[1] and out[2] < 0.5
    assert out[3] == out[4] == pytest.approx(1 / (1 + np.exp(-weights[-1])))
    slots, values = features(texts[0].encode(), 18)
    assert out[0] == pytest.approx(1 / (1 + np.exp(-(weights[slots] @ values + weights[-1]))))


def test_held_out_accuracy(spark):
    """On the given labels: rows that are never learned from are told apart."""
    out = op7_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = out.where("held_out").select("doc_id", "score", "predicted", "quality").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"])
    good, bad = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    assert (good["predicted"] == 1).mean() > 0.98 and (bad["predicted"] == 0).mean() > 0.8
    wins = (good["score"].to_numpy()[:, None] > bad["score"].to_numpy()[None]).mean()
    assert wins > 0.99


def test_held_out_labels_have_no_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    labels.withColumn("quality", other).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = quality_scores(spark, docs, sf).select("doc_id", "quality_score").collect()
    b = quality_scores(spark, docs, str(tmp_path)).select("doc_id", "quality_score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_training_bound(spark):
    """The sample has no more rows than README states, also where ids repeat."""
    assert Settings().max_rows == 20_000
    docs = spark.range(300).selectExpr("id % 100 as doc_id", "concat('text ', id) as text")
    labels = spark.range(400).selectExpr("id % 200 as doc_id", "cast(id % 2 as int) as quality")
    sample = training_sample(docs, labels, "quality", Settings(max_rows=60)).collect()
    assert len(sample) <= 60 and len({r["key"] for r in sample}) == len(sample) > 10
    assert all(r["text"] == min(f"text {r['key'] + d}" for d in (0, 100, 200)) for r in sample)
