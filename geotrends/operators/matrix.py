"""Matrices: one measure over two keys, wide or long."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrends.operators.aggregates import exact_mean, exact_sum


def _cell(df: DataFrame, value: str, agg: str, order: Sequence[str]) -> Column:
    if agg == "mean":
        return exact_mean(df, value)
    if agg == "sum":
        return exact_sum(df, value)
    if agg == "first":
        return F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*(order or [value]))))
    raise ValueError(f"unknown cell aggregate: {agg}")


def matrix(
    df: DataFrame,
    index: str,
    columns: str,
    value: str,
    agg: str = "mean",
    values: Sequence | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """One row per ``index``, one column per value of ``columns``.

    Give ``values`` to fix the columns: without them Spark runs an extra job
    for the distinct values. For a key with many values use
    :func:`matrix_long`, which holds the same cells as rows. ``first`` takes
    the filled value of the first row in ``order``.
    """
    keyed = df.dropna(subset=[index, columns])
    wide = keyed.groupBy(index).pivot(columns, list(values) if values is not None else None)
    return wide.agg(_cell(df, value, agg, order))


def matrix_long(
    df: DataFrame,
    x: str,
    y: str,
    value: str,
    agg: str = "mean",
    layers: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """The cells of a matrix as rows ``x, y, z`` with further layers.

    Each layer holds the value of the first row of the cell in ``order``; all
    layers of a cell come from that same row.
    """
    keyed = df.dropna(subset=[x, y])
    cells = [_cell(df, value, agg, order).alias("z")]
    if layers:
        cells.append(F.min_by(F.struct(*layers), F.struct(*order, *layers)).alias("_first"))
    grid = keyed.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(*cells)
    return grid.select("x", "y", "z", *[F.col(f"_first.{name}").alias(name) for name in layers])
