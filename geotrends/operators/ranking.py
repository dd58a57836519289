"""Top, middle and bottom of ranked frames.

A limited list is ``orderBy().limit()``: every task keeps its own best rows
and only those meet, so no rank over all rows is ever computed.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.fixed_values import ALL, EDGE_ROWS, PLACE_LIMITS, STATE_LIMITS
from geotrends.operators.aggregates import exact_sum
from geotrends.operators.joins import join_keys
from geotrends.operators.scope import filter_scope
from geotrends.session import materialize


def head_n(df: DataFrame, by: str, keys: Sequence[str], n: int = EDGE_ROWS) -> DataFrame:
    """The ``n`` largest rows by ``by``; ties in the order of ``keys``."""
    return df.orderBy(F.desc(by), *keys).limit(n)


def tail_n(df: DataFrame, by: str, keys: Sequence[str], n: int = EDGE_ROWS) -> DataFrame:
    """The ``n`` last rows of the same order."""
    return df.orderBy(F.asc(by), *[F.desc(k) for k in keys]).limit(n)


def middle_slice(
    df: DataFrame, by: str, keys: Sequence[str], head: int = EDGE_ROWS, tail: int = EDGE_ROWS
) -> DataFrame:
    """Rows between the first ``head`` and the last ``tail``; none when those cover all.

    ``keys`` identify a row. At most ``head + tail`` of them are broadcast. The
    ranked frame is kept, as both ends and the middle are taken from it.
    """
    df = materialize(df)
    edges = head_n(df, by, keys, head).select(*keys).unionByName(tail_n(df, by, keys, tail).select(*keys))
    return join_keys(df, F.broadcast(edges), keys, "left_anti")


def top_places(
    df: DataFrame,
    places: Sequence[str],
    year: int | str = ALL,
    quarter: str = ALL,
    measure: str = "registered_users",
    carry: str | None = None,
    by_state: bool = False,
) -> DataFrame:
    """Places with the most users.

    One row per place and period, or per place alone when the scope is open.
    The list is longer when exactly one of year and quarter is open. ``carry``
    shows one (the smallest) value of a column that is not a key, which is how
    places of the same name in different states are merged; ``by_state`` keeps
    them apart.
    """
    keys = ["state", *places] if by_state and "state" not in places else list(places)
    if year != ALL or quarter != ALL:
        keys += ["year", "quarter"]
    one_open, otherwise = STATE_LIMITS if list(places) == ["state"] else PLACE_LIMITS
    limit = one_open if (year == ALL) != (quarter == ALL) else otherwise
    carried = [F.min(carry).alias(carry)] if carry and carry not in keys else []
    scoped = filter_scope(df, year=year, quarter=quarter)
    return (
        scoped.groupBy(*keys)
        .agg(*carried, exact_sum(df, measure).alias("users"))
        .orderBy(F.desc("users"), *keys)
        .limit(limit)
    )


def order_by_category(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    """Rows in a declared order of categories; unknown ones last."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.orderBy(F.nullif(place, F.lit(0)).asc_nulls_last(), *then)
