"""Totals, trends, rankings and distinct lists.

All grouping is by ``groupBy().agg()`` with aggregates that combine on the map
side, so a key that holds a large part of the rows costs one row per task in
the shuffle. Sums of amounts are exact and do not depend on the row order.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrends.fixed_values import ALL, GROSS, GROWTH_BASE_YEAR, GROWTH_YEAR
from geotrends.functions.numbers import money_sum, number_scale, number_text, pct_change, round2
from geotrends.operators.scope import filter_scope
from geotrends.session import materialize

# Column -> output name; a list keeps the names.
Measures = dict[str, str] | Sequence[str]

TRANSACTIONS = {"transaction_count": "count", "transaction_amount": "amount"}


def _named(measures: Measures) -> dict[str, str]:
    return dict(measures) if isinstance(measures, dict) else {m: m for m in measures}


def exact_sum(df: DataFrame, name: str) -> Column:
    """Sum of a column that does not depend on the row order; NaN does not count."""
    return money_sum(F.col(name)) if isinstance(df.schema[name].dataType, T.DoubleType) else F.sum(name)


def exact_mean(df: DataFrame, name: str) -> Column:
    """Mean of a column from its exact sum; NaN does not count."""
    counted = F.col(name)
    if isinstance(df.schema[name].dataType, T.DoubleType):
        counted = F.when(~F.isnan(name), counted)
    return exact_sum(df, name).cast("double") / F.nullif(F.count(counted), F.lit(0))


def sum_columns(df: DataFrame, measures: Measures) -> list[Column]:
    return [exact_sum(df, source).alias(name) for source, name in _named(measures).items()]


def with_text(df: DataFrame, texts: dict[str, str], as_double: bool = False) -> DataFrame:
    """Add the human-readable text of each column: ``{column: name of the text}``.

    ``as_double`` prints whole numbers like doubles, as database sums appear.
    The steps of :func:`human_number` stand in projections of their own, so
    that each is computed once per row.
    """
    number = {s: F.col(s).cast("double") if as_double else F.col(s) for s in texts}
    scales = df.withColumns({f"_{s}_scale": number_scale(c) for s, c in number.items()})
    scaled = scales.withColumns({f"_{s}_scaled": c / F.col(f"_{s}_scale.size") for s, c in number.items()})
    shown = {t: number_text(number[s], F.col(f"_{s}_scale"), F.col(f"_{s}_scaled")) for s, t in texts.items()}
    return scaled.select(*df.columns, *[c.alias(t) for t, c in shown.items()])


def regroup_sum(df: DataFrame, keys: Sequence[str], measures: Measures) -> DataFrame:
    """Sums by ``keys``; rows with a null key are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*sum_columns(df, measures))


def grand_total(df: DataFrame, measures: Measures) -> DataFrame:
    """One row with the sum of each measure."""
    return df.agg(*sum_columns(df, measures))


def period_trend(df: DataFrame, measures: Measures) -> DataFrame:
    """Sums by year and quarter."""
    return df.groupBy("year", "quarter").agg(*sum_columns(df, measures))


def place_sums(
    df: DataFrame,
    places: Sequence[str],
    year: int | str = ALL,
    measures: Measures = TRANSACTIONS,
) -> DataFrame:
    """Sums by place, in no order; a chosen year is shown."""
    sums = filter_scope(df, year=year).groupBy(*places).agg(*sum_columns(df, measures))
    return sums if year == ALL else sums.withColumn("year", F.lit(int(year)))


def rank_places(
    df: DataFrame,
    places: Sequence[str],
    year: int | str = ALL,
    measures: Measures = TRANSACTIONS,
) -> DataFrame:
    """Sums by place, largest first measure first; ties in place order."""
    first = next(iter(_named(measures).values()))
    return place_sums(df, places, year, measures).orderBy(F.desc(first), *places)


def one_per_key(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] = ()) -> DataFrame:
    """One row per key with one filled value of the group: the first by ``order``, else the smallest."""
    filled = F.when(F.col(value).isNotNull(), F.struct(*order, value))
    picked = F.min_by(value, filled) if order else F.min(value)
    return df.groupBy(*keys).agg(picked.alias(value))


def conditional_growth(
    df: DataFrame,
    key: str = "state",
    value: str = "insurance_count",
    cur: int = GROWTH_YEAR,
    base: int = GROWTH_BASE_YEAR,
) -> DataFrame:
    """Sums of two years side by side with the growth in percent (null from zero)."""

    def of(year: int) -> Column:
        return F.sum(F.when(F.col("year") == year, F.col(value)).otherwise(F.lit(0)))

    # Other years add nothing but still bring their key, so they stay in.
    sums = df.groupBy(key).agg(of(cur).alias(f"count_{cur}"), of(base).alias(f"count_{base}"))
    now, before = F.col(f"count_{cur}"), F.col(f"count_{base}")
    return sums.withColumn("growth_percent", round2(F.when(before != 0, pct_change(now, before))))


def period_totals(df: DataFrame, periods: DataFrame, by: str, measures: Measures) -> DataFrame:
    """One total per listed period, zero where ``df`` has none."""
    names = list(_named(measures).values())
    totals = df.groupBy(by).agg(*sum_columns(df, measures))
    return periods.select(by).distinct().join(totals, by, "left").fillna(0, subset=names)


def totals_with_gross(df: DataFrame, by: str, measures: Measures, periods: DataFrame | None = None) -> DataFrame:
    """Totals per ``by`` and the total of all, in a ``scope`` column.

    The rollup runs over the per-period totals, not over the rows.
    """
    names = list(_named(measures).values())
    if periods is None:
        totals = df.groupBy(by).agg(*sum_columns(df, measures))
    else:
        totals = period_totals(df, periods, by, measures)
    label = F.when(F.grouping(by) == 1, F.lit(GROSS)).otherwise(F.col(by).cast("string"))
    return totals.rollup(by).agg(label.alias("scope"), *sum_columns(totals, names)).select("scope", *names)


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values in order."""
    return df.select(*columns).distinct().orderBy(*columns)


def children_by_parent(df: DataFrame, parent: str = "state", child: str = "district") -> DataFrame:
    """Each parent with the sorted list of its distinct children.

    Duplicates go first, spread over both keys, so a parent with most of the
    rows only brings its distinct children to one place. Where a parent can have very
    many, use :func:`children_parts` instead.
    """
    pairs = df.select(parent, child).dropna().distinct()
    return pairs.groupBy(parent).agg(F.sort_array(F.collect_list(child)).alias(f"{child}s"))


def children_parts(df: DataFrame, parent: str = "state", child: str = "district", size: int = 10_000) -> DataFrame:
    """``parent, part, <child>s``: sorted lists of distinct children, at most ``size`` in a row.

    The parts of a parent are numbered from 0 in the order of their children.
    The distinct pairs are numbered in a range sort, which splits a parent with very
    many children over tasks, and ``size`` consecutive numbers make a part.
    """
    from geotrends.sinks.tables import with_surrogate_id

    pairs = df.select(F.col(parent).alias("_parent"), F.col(child).alias("_child")).dropna().distinct()
    numbered = with_surrogate_id(pairs, ["_parent", "_child"], "_id")
    at = F.floor((F.col("_id") - 1) / F.lit(size))
    lists = numbered.groupBy("_parent", at.alias("_at")).agg(F.sort_array(F.collect_list("_child")).alias("_children"))
    lists = materialize(lists)
    first = lists.groupBy("_parent").agg(F.min("_at").alias("_first"))
    return lists.join(first, "_parent").select(
        F.col("_parent").alias(parent), (F.col("_at") - F.col("_first")).cast("int").alias("part"), F.col("_children").alias(f"{child}s")
    )


def value_range(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value; empty cells do not count."""
    c = F.col(column)
    return df.agg(F.min(c).alias("low"), F.max(c).alias("high"))


def centroid(df: DataFrame) -> DataFrame:
    """Mean of the coordinates."""
    return df.agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def pad_periods(trend: DataFrame, rows: DataFrame) -> DataFrame:
    """The trend with extra period rows put before it."""
    return rows.unionByName(trend)
