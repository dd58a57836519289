"""The registered queries against their SQL, and the pipeline against plain versions."""

import glob
import os

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geotrends.llm.q_packing import packed
from geotrends.llm.queries import LLM_ORACLES, LLM_QUERIES
from geotrends.llm.shared_store import written

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(LLM_ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = sorted(map(str, result.fetchall()))
    found = LLM_QUERIES[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in found.select(*columns).collect()) == expected


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in LLM_QUERIES


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = written(stages["quality"](spark, docs, SF_DIR), "t1")
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    first, all_ids = texts(kept), {r["doc_id"] for r in docs.collect()}
    assert kept.columns == columns
    gone = all_ids - {i for i, _ in first}
    assert not [i for i in gone if labels.get(i, 0) == 1]
    near = written(stages["near_dedup"](spark, kept, SF_DIR), "t2")
    second = texts(near)
    assert near.columns == columns
    assert second == [(i, t) for i, t in first if brute.near_duplicates(first)[i][1] == i]
    cut = written(stages["substring_dedup"](spark, near, SF_DIR), "t3")
    third = texts(cut)
    plain = brute.remove_repeats([t for _, t in second])
    assert cut.columns == columns and cut.where("n_chars <> length(text)").count() == 0
    assert third == [(i, k if len(k.split()) < n else t) for (i, t), (n, k) in zip(second, plain)]
    clean = written(stages["decontamination"](spark, cut, SF_DIR), "t4")
    fourth = texts(clean)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert clean.columns == columns
    assert fourth == [(i, t) for i, t in third if not brute.overlapped(t, items)]
    last = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in stages["packing"](spark, clean, SF_DIR).select("doc_id", "start", "ids_crc32").collect()}
    assert {i for i, _, _ in last} == {i for i, _ in fourth}
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert whole.columns == packed(docs).columns and {r["doc_id"] for r in whole.select("doc_id").collect()} == {i for i, _ in fourth}


def test_pipeline_keeps_one_row_of_a_group(spark):
    long = [" ".join(f"{c}{i}" for i in range(50)) for c in "abcdef"]
    near = long[2] + " more"
    rows = [
        (7, long[0]), (7, long[0]), (None, long[0]),  # loaded twice, and once without its id
        (None, long[1]), (None, long[1]),  # no id at all
        (3, long[2]), (4, near), (4, long[3]),  # a dropped id that another text uses
        (5, long[4]), (5, long[4] + " end"),  # near copies of one id
        (6, long[5]), (8, None), (8, None), (9, " "),
    ]
    docs = [(i, t, "en", "s", len(t or ""), k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, _row int").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    kept = written(stages["near_dedup"](spark, docs, SF_DIR), "t5")
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    fives = [x for x in found if x[0] == 5]
    assert kept.columns == docs.columns and len(fives) == 1 and fives[0] in rows
    expected = [(7, long[0]), (None, long[1]), (3, long[2]), (4, long[3]), (6, long[5]), (8, None), (8, None), (9, " "), *fives]
    assert found == sorted(expected, key=str)
    cut = stages["substring_dedup"](spark, kept, SF_DIR).collect()
    assert sorted(((r["doc_id"], r["text"] or None) for r in cut if (r["text"] or "").strip()), key=str) == sorted(
        (x for x in expected if (x[1] or "").strip()), key=str
    )


def test_pipeline_passes_further_columns(spark):
    """Whatever their names are, and whatever the stages call their own columns."""
    names = ["quality_score", "_dropped_id", "a.b", "key", "row", "_row", "component_id", "carried", "kept", "Text 2", "further_column_1"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 60")
    more = docs.select("*", *[F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(names)])
    stages = dict(corpus_pipeline.STAGES)
    plain = docs
    for name in ("quality", "near_dedup", "substring_dedup", "decontamination"):
        plain, more = (written(stages[name](spark, d, SF_DIR).toDF(*[f"c{i}" for i in range(len(d.columns))]), "t6").toDF(*d.columns) for d in (plain, more))
        assert more.columns == [*docs.columns, *names]
        rows = [tuple(r) for r in more.collect()]
        assert all(r[5:] == tuple(f"{i}-{r[0]}" for i in range(len(names))) for r in rows)
        assert sorted(r[:5] for r in rows) == sorted(tuple(r) for r in plain.collect())
    assert stages["packing"](spark, more, SF_DIR).count() > 0


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
