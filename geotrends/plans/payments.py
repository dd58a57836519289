"""Payment modes for any scope of state, year and quarter."""

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.fixed_values import ALL
from geotrends.operators.aggregates import grand_total, regroup_sum, totals_with_gross, value_range, with_text
from geotrends.operators.matrix import matrix_long
from geotrends.operators.scope import filter_scope, latest_rows
from geotrends.operators.windows import with_log, with_total
from geotrends.plans.outputs import Outputs
from geotrends.session import materialize

_MEASURES = ["transaction_count", "transaction_amount"]
_TEXTS = {"transaction_count": "count", "transaction_amount": "amount"}
_SUM_TEXTS = {"transaction_count": "count_s", "transaction_amount": "amount_s"}


@dataclass(frozen=True)
class ScopeView:
    """What is shown for one kind of scope.

    ``totals_by``: period of the totals next to the gross total, if any.
    ``start``: rows the map starts with: (column, value) or (column, "min" / "max").
    ``sum_by``: period of the totals put on the map rows; "" is the whole frame, None is no totals.
    ``grid``: keys of the period matrix, (x, y). ``type_x``: key that crosses the payment type.
    ``extra``: further columns shown per cell of the type matrix.
    """

    totals_by: str | None
    start: tuple[str, str] | None
    sum_by: str | None
    grid: tuple[str, str] | None
    type_x: str
    extra: tuple[str, ...] = ()


# (one state?, one year?, one quarter?) -> view. Fixed by what each scope shows.
SCOPE_VIEWS: dict[tuple[bool, bool, bool], ScopeView] = {
    (False, False, False): ScopeView("year", ("year", "min"), None, ("state", "year"), "state"),
    (False, True, False): ScopeView("quarter", ("quarter", "Q4"), None, ("state", "quarter"), "state", ("year",)),
    (False, False, True): ScopeView("year", ("year", "max"), None, ("state", "year"), "state", ("quarter",)),
    (False, True, True): ScopeView(None, None, None, ("state", "quarter"), "state", ("quarter", "year")),
    (True, False, True): ScopeView(None, ("year", "max"), "year", ("year", "quarter"), "year", ("quarter",)),
    (True, False, False): ScopeView("year", ("year", "max"), "year", ("year", "quarter"), "year", ("quarter",)),
    (True, True, False): ScopeView(None, ("quarter", "Q1"), "quarter", ("quarter", "year"), "quarter", ("year",)),
    (True, True, True): ScopeView(None, None, "", None, "year", ("quarter",)),
}


def _starting(df: DataFrame, start: tuple[str, str] | None) -> DataFrame:
    if start is None:
        return df
    column, value = start
    if value in ("min", "max"):
        return latest_rows(df, column, value)
    return df.filter(F.col(column) == value)


def _mapped(rows: DataFrame, view: ScopeView) -> DataFrame:
    mapped = with_log(rows, "transaction_count")
    if view.sum_by is None:
        return mapped
    sums = {"transaction_count": "_count_sum", "transaction_amount": "_amount_sum"}
    summed = with_total(mapped, sums, view.sum_by or None)
    return with_text(summed, {name: name[1:] for name in sums.values()}).drop(*sums.values())


def payment_modes(
    transactions: DataFrame, state: str = ALL, year: int | str = ALL, quarter: str = ALL
) -> Outputs:
    """All outputs for one scope of the aggregated transactions.

    ``rows`` (with texts), ``totals``, ``map`` and ``map_start``,
    ``type_matrix`` and, but for a single period of a single state, ``periods``
    (regrouped sums), ``period_matrix`` and ``period_range``. Period totals
    list every period of the table, with zero where the scope has none.
    """
    view = SCOPE_VIEWS[(state != ALL, year != ALL, quarter != ALL)]
    everything = (state, year, quarter) == (ALL, ALL, ALL)

    # The scope is read once and kept: totals, bounds and the map look at it again.
    @cache
    def scoped() -> DataFrame:
        return materialize(filter_scope(transactions, state, year, quarter))

    def totals() -> DataFrame:
        if view.totals_by:
            periods = scoped() if everything else transactions
            return with_text(totals_with_gross(scoped(), view.totals_by, _MEASURES, periods), _TEXTS)
        return with_text(grand_total(scoped(), _MEASURES), _TEXTS)

    def rows() -> DataFrame:
        return with_text(scoped(), _TEXTS)

    def mapped() -> DataFrame:
        return _mapped(rows(), view)

    def types() -> DataFrame:
        layers = ["count", "amount", *view.extra]
        return matrix_long(
            rows(), view.type_x, "transaction_type", "transaction_count", layers=layers, order=["year", "quarter"]
        )

    def periods() -> DataFrame:
        yearly = view.totals_by == "year" and (state, quarter) == (ALL, ALL)
        keys = ["state", "year"] if yearly else ["state", "year", "quarter"]
        return with_text(regroup_sum(scoped(), keys, _MEASURES), _SUM_TEXTS)

    def cells() -> DataFrame:
        x, y = view.grid
        return matrix_long(periods(), x, y, "transaction_count", layers=["count_s", "amount_s"])

    outputs = {
        "rows": rows,
        "totals": totals,
        "map": mapped,
        # Whole periods are kept, so their totals stay the same.
        "map_start": lambda: _mapped(_starting(rows(), view.start), view),
        "type_matrix": types,
    }
    if view.grid:
        outputs |= {"periods": periods, "period_matrix": cells, "period_range": lambda: value_range(cells(), "z")}
    return Outputs(outputs)
