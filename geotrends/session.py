"""Session helpers: settings that every job relies on."""

import re

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Building a plan is about twice as fast without call-site capture.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "geotrends", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's settings and further ones given by name."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate data, the same rule on every master.

    ``spark.checkpoint.dir`` where it is set, else a folder below
    ``spark.sql.warehouse.dir``, which every session has and all its
    executors reach.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute a frame once and keep it on the shared storage.

    For a grouped frame that a plan refers to several times: each reference
    would otherwise prune other columns and scan the tables again. The copy
    outlives lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def computed_once(df: DataFrame) -> DataFrame:
    """A frame for a plan that refers to it twice.

    One that is grouped, joined or sorted is stored, so its input is read
    once. A plain scan stays one: each reference reads only the columns and
    partitions it needs, which is less than storing all rows.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return materialize(df) if re.search(r"\b(Aggregate|Join|Window|Sort|Expand|Generate)\b", plan) else df
