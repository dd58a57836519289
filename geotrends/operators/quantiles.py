"""Exact quantiles without gathering a group.

``percentile`` keeps all distinct values of a group in one task. Here values
are counted by buckets of their size straight from the scan; only the rows of
the buckets that hold a wanted rank are kept, grouped by value and cut again.
The first buckets divide each power of two evenly, as the bits of a double do, so
every cut divides any data, and its number of buckets is bounded.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrends.functions.numbers import truncate_int
from geotrends.operators.joins import join_keys

# First cut: buckets per power of two, at most 2 * 64 * 2100 over all doubles.
_PARTS = 64
_INFINITE = 1 << 30
# Later cuts: equal parts between the smallest and largest value of a bucket.
# After two of them at most a few thousand doubles are left in a bucket.
_EVEN_BUCKETS = 65536
_EVEN_CUTS = 2


def _first_bucket(v: Column) -> Column:
    """Whole number that never falls when ``v`` rises."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    # In two steps, as one power alone would be zero or infinite for the smallest numbers.
    half = F.floor(power / 2)
    within = size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), power - half) - 1
    part = F.least(F.greatest(F.floor(within * _PARTS), F.lit(0)), F.lit(_PARTS - 1))
    bucket = F.when(size == float("inf"), F.lit(_INFINITE)).otherwise((power + 1100) * _PARTS + part)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * bucket).cast("int")


def _even_bucket(v: Column, low: Column, high: Column) -> Column:
    part = (v - low) / F.nullif(high - low, F.lit(0.0))
    cell = F.when(low != high, F.floor(part * (_EVEN_BUCKETS - 1)).cast("int"))
    return F.coalesce(cell, F.lit(0))


def _ranks(probabilities: Sequence[float]) -> list[str]:
    return [f"_r{i}" for i in range(2 * len(probabilities))]


def _holding(df: DataFrame, keys: Sequence[str], order: str, size: str, ranks: Sequence[str]) -> DataFrame:
    """Rows that hold a wanted rank of their group.

    A rank counts from the start of the group; after this, from the start of
    the row that holds it, and is null on all others.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = df.withColumn("_last", F.sum(size).over(upto)).withColumn("_first", F.col("_last") - F.col(size))
    within = {
        r: F.when((F.col(r) >= F.col("_first")) & (F.col(r) < F.col("_last")), F.col(r) - F.col("_first")) for r in ranks
    }
    return placed.withColumns(within).filter(F.coalesce(*ranks).isNotNull()).drop("_first", "_last")


def _neighbours(df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Per group the number of values and, per probability, the values at both neighbouring ranks."""
    ranks = _ranks(probabilities)
    rows = (
        df.select(*by, F.col(column).cast("double").alias("_v"), F.lit(1).cast("bigint").alias("_n"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_b0", _first_bucket(F.col("_v")))
    )
    keys, carried = list(by), []
    for cut in range(_EVEN_CUTS + 1):
        bucket = f"_b{cut}"
        cells = rows.groupBy(*keys, bucket).agg(
            F.sum("_n").alias("_size"),
            F.min("_v").alias("_low"),
            F.max("_v").alias("_high"),
            *[F.max(c).alias(c) for c in carried],
        )
        if not carried:
            cells = cells.withColumn("_total", F.sum("_size").over(Window.partitionBy(*keys)))
            at = [F.lit(float(p)) * (F.col("_total") - 1) for p in probabilities]
            wanted = [rank.cast("bigint") for a in at for rank in (F.floor(a), F.ceil(a))]
            cells = cells.withColumns(dict(zip(ranks, wanted)))
            carried = ["_total", *ranks]
        cells = _holding(cells, keys, bucket, "_size", ranks)
        keys = [*keys, bucket]
        if cut:
            kept = cells.select(*keys, "_low", "_high", *carried)
            narrowed = join_keys(rows.select(*keys, "_v", "_n"), kept, keys)
        else:
            # Only the rows of wanted buckets are shuffled by value.
            wanted_rows = join_keys(rows.select(*keys, "_v", "_n"), cells.select(*keys), keys)
            counted = wanted_rows.groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
            narrowed = join_keys(counted, cells.select(*keys, "_low", "_high", *carried), keys)
        next_bucket = _even_bucket(F.col("_v"), F.col("_low"), F.col("_high"))
        rows = narrowed.withColumn(f"_b{cut + 1}", next_bucket).drop("_low", "_high")
    found = _holding(rows, keys, "_v", "_n", ranks)
    return found.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[F.max(F.when(F.col(r).isNotNull(), F.col("_v"))).alias(r) for r in ranks],
    )


def _interpolated(probabilities: Sequence[float]) -> list[Column]:
    ranks = [F.col(r) for r in _ranks(probabilities)]
    quantiles = []
    for p, low, high in zip(probabilities, ranks[::2], ranks[1::2]):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        quantiles.append(F.when(low == high, low).otherwise(low + (at - F.floor(at)) * (high - low)))
    return quantiles


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles with linear interpolation: one row per group and probability.

    Columns: the ``by`` columns, ``probability``, ``quantile``. Null and NaN do
    not count; infinite values are the smallest and largest ones.
    """
    found = _neighbours(df, column, probabilities, by)
    points = [
        F.struct(F.lit(float(p)).alias("probability"), q.alias("quantile"))
        for p, q in zip(probabilities, _interpolated(probabilities))
    ]
    filled = found.filter(F.col("_total").isNotNull())
    return filled.select(*by, F.inline(F.array(*points)))


def iqr_bounds(df: DataFrame, column: str, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Whole parts of the median and of the fences ``Q1 - 1.5 * (Q3 - Q1)`` and ``Q3 + 1.5 * (Q3 - Q1)``.

    ``approx`` uses one pass with a sketch; the same values count. The whole
    part of an infinite or unknown number is null.
    """
    points = [0.25, 0.5, 0.75]
    if approx:
        value = F.col(column).cast("double")
        sketch = F.percentile_approx(F.when(~F.isnan(value), value), points, 10000)
        quartiles = df.groupBy(*by).agg(sketch.alias("_q"))
        q1, q2, q3 = (F.col("_q")[i] for i in range(3))
    else:
        quartiles = _neighbours(df, column, points, by)
        q1, q2, q3 = _interpolated(points)
    return quartiles.select(
        *by,
        q1.alias("q1"),
        q2.alias("q2"),
        q3.alias("q3"),
        _whole(q2).alias("median"),
        _whole(q1 - 1.5 * (q3 - q1)).alias("lower"),
        _whole(q3 + 1.5 * (q3 - q1)).alias("upper"),
    )


def _whole(c: Column) -> Column:
    return truncate_int(F.when(F.abs(c) < 2.0**63, c))
