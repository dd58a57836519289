"""Writing the flat tables."""

import re
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrends.fixed_values import LOCATION_BATCH_ROWS
from geotrends.operators.quality import check_schema
from geotrends.schemas import SCHEMAS
from geotrends.session import materialize


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with a header; quotes inside a value are doubled, blanks stay."""
    options = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**options).csv(path)


def normalize_columns(df: DataFrame, table: str | None = None) -> DataFrame:
    """Lower-case column names; with ``table``, the columns of that table in its order."""
    lower = df.toDF(*[c.lower() for c in df.columns])
    return lower.select(*SCHEMAS[table].names) if table else lower


def _partitioned(table: str) -> bool:
    return "year" in SCHEMAS[table].names


def _name(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def _versions(spark: SparkSession, db: str) -> set[str]:
    """The databases that hold versions of the tables of ``db``."""
    return {r[0] for r in spark.sql("SHOW DATABASES").collect() if r[0].startswith(f"{db}__v")}


def _new_version(spark: SparkSession, db: str, tables: Iterable[str]) -> str:
    """A database beside the present one with empty tables; those with a year are partitioned by it."""
    version = f"{db}__v{uuid.uuid4().hex[:12]}"
    described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE DATABASE {_name(db)}").collect()}
    location = f"{described['Location'].rstrip('/')}/versions/{version}"
    quoted = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE DATABASE {_name(version)} LOCATION '{quoted}'")
    for table in tables:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[table].fields)
        by = " PARTITIONED BY (year)" if _partitioned(table) else ""
        spark.sql(f"CREATE TABLE {_name(version, table)} ({columns}) USING parquet{by}")
    return version


def _version_of(spark: SparkSession, db: str, table: str) -> str | None:
    """The version that a table of ``db`` shows, if there is such a table."""
    if not spark.catalog.tableExists(_name(db, table)):
        return None
    rows = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_name(db, table)}").collect()}
    found = re.search(r" FROM `((?:[^`]|``)+)`\.", rows.get("View Text") or "")
    if found is None:
        raise ValueError(f"{db}.{table} is not a view of a version")
    return found[1].replace("``", "`")


def _show(spark: SparkSession, db: str, table: str, version: str | None) -> None:
    if version is None:
        spark.sql(f"DROP VIEW IF EXISTS {_name(db, table)}")
        return
    columns = ", ".join(_name(c) for c in SCHEMAS[table].names)
    spark.sql(f"CREATE OR REPLACE VIEW {_name(db, table)} AS SELECT {columns} FROM {_name(version, table)}")


def _switch(spark: SparkSession, db: str, tables: Iterable[str], version: str) -> set[str]:
    """Let ``tables`` show a new version, or all their old ones if that fails; the versions shown before."""
    before = {table: _version_of(spark, db, table) for table in tables}
    done = []
    try:
        for table in before:
            done.append(table)
            _show(spark, db, table, version)
    except BaseException:
        for table in done:
            _show(spark, db, table, before[table])
        raise
    return {v for v in before.values() if v}


def create_tables(spark: SparkSession, db: str, location: str | None = None) -> None:
    """Create the database and its 14 tables where they are missing.

    A table is a view of the present version of its rows, which lie in a database of
    their own below the location of ``db``.
    """
    where = " LOCATION '" + location.replace("\\", "\\\\").replace("'", "\\'") + "'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_name(db)}{where}")
    missing = [table for table in SCHEMAS if not spark.catalog.tableExists(_name(db, table))]
    if missing:
        _switch(spark, db, missing, _new_version(spark, db, missing))


def drop_tables(spark: SparkSession, db: str) -> None:
    """Drop the database and all versions of its tables."""
    spark.sql(f"DROP DATABASE IF EXISTS {_name(db)} CASCADE")
    for version in _versions(spark, db):
        spark.sql(f"DROP DATABASE IF EXISTS {_name(version)} CASCADE")


def refresh(spark: SparkSession, db: str, tables: Mapping[str, DataFrame]) -> None:
    """Replace all rows of all given tables in one step; columns are matched by name.

    Every frame is checked before anything is written. The new rows are written
    beside the present ones and counted; only then are the tables switched to them,
    which moves no data. If anything fails before, all tables show their old rows. The
    version shown before is kept until the next refresh, for queries that still read
    it. The rebalance step groups a year into files of a fair size and splits a
    year that holds most of the rows over several tasks.
    """
    frames = {}
    for table, df in tables.items():
        frame = normalize_columns(df)
        check_schema(frame, SCHEMAS[table])
        frames[table] = normalize_columns(frame, table)
    version = _new_version(spark, db, frames)
    try:
        for table, frame in frames.items():
            target = _name(version, table)
            seen = Observation()
            spread = frame.hint("rebalance", "year") if _partitioned(table) else frame.hint("rebalance")
            counted = spread.observe(seen, F.count(F.lit(1)).alias("rows"))
            counted.select(*spark.table(target).columns).write.insertInto(target)
            rows = spark.table(target).count()
            if rows != seen.get["rows"]:
                raise RuntimeError(f"{rows} rows of {seen.get['rows']} were written to {target}")
        before = _switch(spark, db, frames, version)
    except BaseException:
        spark.sql(f"DROP DATABASE IF EXISTS {_name(version)} CASCADE")
        raise
    shown = {_version_of(spark, db, table) for table in SCHEMAS}
    for old in _versions(spark, db) - before - shown:
        spark.sql(f"DROP DATABASE IF EXISTS {_name(old)} CASCADE")


def write_jdbc(
    df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None, connections: int = 8
) -> None:
    """Truncate and load a database table over at most ``connections`` connections; location tables go in small batches."""
    writer = df.write.mode("overwrite").option("truncate", True).option("numPartitions", connections)
    if table.endswith("location_metrics"):
        writer = writer.option("batchsize", LOCATION_BATCH_ROWS)
    writer.jdbc(url, table, properties=dict(properties or {}))


def with_surrogate_id(df: DataFrame, order_by: Sequence[str], name: str = "id") -> DataFrame:
    """Number the rows from 1 in ``order_by``, without a window over all rows.

    The rows are range-sorted and checkpointed, which fixes who is in which
    partition; each partition then starts after the sizes of those before it.
    Only the partition sizes, one row per task, are summed in one place.
    """
    # Partition number in the high bits, position within it in the low 33.
    at = F.monotonically_increasing_id()
    fixed = materialize(df.orderBy(*order_by))
    placed = fixed.withColumn("_at", at).select(
        "*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.select((F.col("_start") + F.col("_row") + 1).alias(name), *df.columns)


def register_view(df: DataFrame, name: str) -> None:
    """Name a frame for use in SQL within this session."""
    df.createOrReplaceTempView(name)
