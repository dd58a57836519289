"""Writing trees of JSON documents, one file per document, by tasks."""

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from threading import Lock
from weakref import WeakSet

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_FORMAT = "json_tree"
_LOCK, _REGISTERED = Lock(), WeakSet()  # of sessions that know the format


@dataclass
class _Written(WriterCommitMessage):
    files: int


def _located(root: str) -> tuple[fs.FileSystem, str]:
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    return fs.FileSystem.from_uri(root)


class _Writer(DataSourceArrowWriter):
    """Writes its rows (path, document) below ``root``.

    A file appears under its name only when it is whole, and a task that runs
    again writes the same files again.
    """

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, base = _located(self.root)
        made, count = set(), 0
        for batch in iterator:
            for path, document in zip(batch["path"].to_pylist(), batch["document"].to_pylist()):
                target = posixpath.join(base, path)
                folder = posixpath.dirname(target)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                # Names that begin with an underscore are no data for Spark's readers.
                part = posixpath.join(folder, f"_{posixpath.basename(target)}")
                with store.open_output_stream(part) as out:
                    out.write(document.encode())
                store.move(part, target)
                count += 1
        return _Written(count)


class _Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_tree(df: DataFrame, root: str, path: str = "path", document: str = "document") -> None:
    """Write each ``document`` (JSON text) as the file ``path`` below ``root``, in the tasks that hold the rows.

    Paths are relative, such as ``aggregated/user/country/india/state/goa/2020/1.json``;
    rows with a null in either column are left out, and of rows with one path any stays.
    The root is a folder that all executors reach.
    """
    spark = df.sparkSession
    with _LOCK:
        if spark not in _REGISTERED:
            spark.dataSource.register(_Tree)
            _REGISTERED.add(spark)
    rows = df.select(F.col(path).cast("string").alias("path"), F.col(document).cast("string").alias("document")).dropna()
    rows.write.format(_FORMAT).mode("append").save(root)
