"""Tables written between the steps of an operator, in the shared folder, and bounds of Arrow batches."""

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from geotrends.session import ensure_checkpoint_dir

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let this session send at most about ``most`` bytes per Arrow batch to Python.

    Otherwise only the number of rows is bounded, and ten thousand long texts
    at once are too much for a small executor. A smaller bound stays.
    """
    now = spark.conf.get(_BATCH_BYTES, None) or ""
    digits = now.removesuffix("b")
    if not (digits.isdigit() and 0 < int(digits) <= most):
        spark.conf.set(_BATCH_BYTES, str(most))


_WRITTEN: dict[SparkSession, list[str]] = {}


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared one; deleted when Python ends with the session alive."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark, []).append(folder)
    return folder


def written(df: DataFrame, kind: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as compressed Parquet and read it back: its lineage ends there."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(folder, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(folder)


def drop_written(spark: SparkSession) -> None:
    """Delete the folders of this session; results that still read them must be done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in _WRITTEN.pop(spark, []):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _at_exit() -> None:
    for spark in list(_WRITTEN):
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            drop_written(spark)
