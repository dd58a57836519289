"""Centroid clustering against plain rounds with Python's numbers."""

import hashlib
import math
import random

import pytest

from geotrends.llm.lloyd import Settings, clusters, dealt_out, shards


def _plain(rows, s):
    kept = [
        (i, [math.floor(s.scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == s.columns and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: "g" if i is None else hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[: s.clusters]]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((squared(v, c), k) for k, c in enumerate(centroids))
    for _ in range(s.rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == k]
            if members:
                centroids[k] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = [sum(d for _, d, k in found if k == c) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, d, total[k], sum(total), digests[k]) for i, d, k in found]


def _rows():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(10)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, [9.5] * 10), (None, rows[3][1]), (None, [0.25] * 10)]
    rows += [(400 + i, [-3.0] * 10) for i in range(60)]  # a hot vector
    rows += [(500, None), (501, []), (502, [1.0] * 9), (503, [None] + [1.0] * 9), (504, [math.nan] * 10), (505, [math.inf] + [0.0] * 9), (506, [1.0] * 11)]
    return rows


@pytest.mark.parametrize("s,parts", [
    (Settings(columns=10, block=3, clusters=4, chunk=16), 5), (Settings(columns=10, block=10, clusters=300, rounds=2), 1), (Settings(columns=10, block=1, clusters=1, rounds=0), 3),
])
def test_clusters(spark, s, parts):
    rows = _rows()
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, chunk string")
    found = [tuple(r) for r in clusters(frame.repartition(parts), settings=s).collect()]
    assert sorted(found, key=str) == sorted(_plain(rows, s), key=str)


def test_clusters_of_nothing(spark):
    frame = spark.createDataFrame(_rows()[-7:], "vec_id bigint, embedding array<double>")
    none = clusters(frame, settings=Settings(columns=10, clusters=3))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]
    assert clusters(frame.limit(0)).count() == 0


def test_only_the_assignment_moves(spark):
    """The shards are dealt out once: joining them with an assignment does not shuffle them again."""
    s = Settings(columns=10, block=5)
    vectors = spark.createDataFrame(_rows()[:150], "id bigint, vec array<double>")
    parts = dealt_out(shards(vectors, s))
    told = spark.createDataFrame([], "chunk bigint, block int, own binary")
    plan = parts.join(told.hint("merge"), ["block", "chunk"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_huge_components_stop(spark):
    frame = spark.createDataFrame([(1, [1e6] * 10)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        clusters(frame, settings=Settings(columns=10)).count()
