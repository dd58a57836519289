"""Profiles and load checks of tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Tables with more columns are compared by digests first.
_WIDE = 12


def _stacked(totals: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """Turn the one row of ``totals`` into one row per item of ``rows``."""
    items = F.array(*[F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows])
    return totals.select(F.inline(items))


def profile_info(df: DataFrame) -> DataFrame:
    """``column, dtype, non_null, rows`` from a single pass."""
    fields = df.schema.fields
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f.name)).alias(f"_n{i}") for i, f in enumerate(fields)]
    )
    rows = [
        [F.lit(f.name), F.lit(f.dataType.simpleString()), F.col(f"_n{i}"), F.col("_rows")]
        for i, f in enumerate(fields)
    ]
    return _stacked(totals, rows, ["column", "dtype", "non_null", "rows"])


def null_counts(df: DataFrame) -> DataFrame:
    """``column, nulls`` from a single pass."""
    totals = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    return _stacked(totals, [[F.lit(c), F.col(f"_n{i}")] for i, c in enumerate(df.columns)], ["column", "nulls"])


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, nulls included."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    # A hash of several columns skips nulls; which ones they are is hashed as well.
    nulls = F.array(*[c.isNull() for c in columns])
    return [F.xxhash64(nulls, *columns), F.xxhash64(F.lit(1), *reversed(columns), nulls)]


def duplicate_count(df: DataFrame, digest: Sequence[Column] | None = None) -> DataFrame:
    """Number of rows equal to an earlier row; null equals null.

    Equal rows are counted before they are shuffled, so a row repeated many
    times costs one record per task. Of wide tables (or with a ``digest``) only
    a digest of each row is grouped; whole rows are compared where digests
    meet, so the count is exact whatever the digest.
    """
    if digest is None and len(df.columns) > _WIDE:
        digest = row_digest(df)
    rows = df
    if digest is not None:
        keys = [f"_digest{i}" for i in range(len(digest))]
        hashed = df.withColumns(dict(zip(keys, digest)))
        met = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(*keys)
        rows = hashed.join(met, keys, "left_semi")
    groups = rows.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def column_list(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table, position, column`` of every table; reads schemas only."""
    rows = [(t, i, c) for t, df in tables.items() for i, c in enumerate(df.columns, start=1)]
    return spark.createDataFrame(rows, "table STRING, position INT, column STRING")


def check_schema(df: DataFrame, schema: T.StructType) -> None:
    """Raise ``ValueError`` when columns are missing, extra or of another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    problems = [f"missing {n}" for n in want if n not in have]
    problems += [f"unexpected {n}" for n in have if n not in want]
    problems += [
        f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}"
        for n in want
        if n in have and have[n] != want[n]
    ]
    if len(have) != len(df.columns):
        problems.append("a column name occurs twice")
    if problems:
        raise ValueError("; ".join(problems))
