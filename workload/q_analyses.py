"""The composite analyses, output by output."""

from pyspark.sql import functions as F

from geotrends.fixed_values import ALL
from geotrends.plans import (
    brand_dominance,
    home_overview,
    insurance_hot_spots,
    open_rates,
    payment_modes,
    prioritise_states,
    registered_users_map,
    rising_districts,
    top_users,
    user_engagement,
    volume_hierarchy,
    volume_places,
)
from geotrends.plans.payments import SCOPE_VIEWS
from workload.q_aggregates import GROWTH_SQL, STATE_YEAR_USERS, TREND_SQL, gross_sql
from workload.q_filters import BRAND, DISTRICT, RATE_CTES, SCOPES, STATE, YEAR, scope_sql
from workload.q_places import _FULL_PATH, PRIORITY, USERS_LOCATION, _hierarchy, rising_sql, top_sql
from workload.registry import query
from workload.views import human_double_sql, human_sql, money_sql, over

# --- home --------------------------------------------------------------------


def _home(t):
    return home_overview(t.map_user, t.agg_transaction, t.map_insurance, t.agg_insurance)


@query(
    "ana01_totals",
    over(
        "map_user agg_transaction map_insurance",
        f"""SELECT metric, total, {human_double_sql('total')} AS total_f FROM (
        SELECT 'registered_users' AS metric, CAST(sum(registered_users) AS BIGINT) AS total FROM map_user
        UNION ALL SELECT 'transactions', CAST(sum(transaction_count) AS BIGINT) FROM agg_transaction
        UNION ALL SELECT 'insurance_transactions', CAST(sum(insurance_count) AS BIGINT) FROM map_insurance)""",
    ),
)
def _(t):
    return _home(t)["totals"]


@query(
    "ana01_user_trend",
    over(
        "map_user",
        f"""SELECT *, {human_double_sql('user_count')} AS user_counts_f, {human_double_sql('open_count')} AS open_counts_f
        FROM (SELECT year, quarter, CAST(sum(registered_users) AS BIGINT) AS user_count,
        CAST(sum(appopen_count) AS BIGINT) AS open_count FROM map_user GROUP BY ALL)""",
    ),
)
def _(t):
    return _home(t)["user_trend"]


@query("ana01_transaction_trend", TREND_SQL)
def _(t):
    return _home(t)["transaction_trend"]


# --- users -------------------------------------------------------------------


@query(
    "ana02_engagement_totals",
    over(
        "map_user",
        f"""SELECT *, {human_double_sql('user_count')} AS user_counts_f, {human_double_sql('open_count')} AS open_counts_f
        FROM (SELECT CAST(year AS VARCHAR) AS scope, CAST(sum(user_count) AS BIGINT) AS user_count,
              CAST(sum(open_count) AS BIGINT) AS open_count FROM ({STATE_YEAR_USERS}) GROUP BY year
              UNION ALL SELECT 'Gross', CAST(sum(user_count) AS BIGINT), CAST(sum(open_count) AS BIGINT) FROM ({STATE_YEAR_USERS}))""",
    ),
)
def _(t):
    return user_engagement(t.map_user, t.map_user)["totals"]


@query(
    "ana02_engagement_map_start",
    over(
        "map_user",
        f"""SELECT *, {human_double_sql('user_count')} AS user_counts_f, {human_double_sql('open_count')} AS open_counts_f,
        round(ln(1 + user_count), 9) AS user_count_log FROM ({STATE_YEAR_USERS})
        WHERE year = (SELECT max(year) FROM map_user)""",
    ),
)
def _(t):
    return user_engagement(t.map_user, t.map_user)["map_start"].withColumn("user_count_log", F.round("user_count_log", 9))


@query(
    "ana02_engagement_matrix",
    over(
        "map_user",
        f"""SELECT state AS x, year AS y, CAST(user_count AS DOUBLE) AS z, {human_double_sql('user_count')} AS user_counts_f,
        {human_double_sql('open_count')} AS open_counts_f FROM ({STATE_YEAR_USERS})""",
    ),
)
def _(t):
    return user_engagement(t.map_user, t.map_user)["matrix"]


_BRAND_ROWS = f"""SELECT state, year, brand, CAST(sum(user_count) AS BIGINT) AS user_count FROM agg_user
WHERE year <> 1999 AND brand = '{BRAND}' GROUP BY ALL"""


@query(
    "ana03_brand_matrix",
    over(
        "agg_user",
        f"""SELECT state AS x, year AS y, CAST(user_count AS DOUBLE) AS z, {human_sql('user_count')} AS count_f, brand
        FROM ({_BRAND_ROWS})""",
    ),
)
def _(t):
    return brand_dominance(t.agg_user, BRAND, skipped_year=1999)["matrix"]


@query(
    "ana03_brand_range",
    over("agg_user", f"SELECT CAST(min(user_count) AS DOUBLE) AS low, CAST(max(user_count) AS DOUBLE) AS high FROM ({_BRAND_ROWS})"),
)
def _(t):
    return brand_dominance(t.agg_user, BRAND, skipped_year=1999)["matrix_range"]


@query("ana04_open_rates_of_brand", over("agg_user map_user", f"SELECT * FROM rates WHERE brand = '{BRAND}'", **RATE_CTES))
def _(t):
    return open_rates(t.agg_user, t.map_user, BRAND)["rates"]


@query(
    "ana04_largest_underutilized",
    over(
        "agg_user map_user",
        """SELECT *, true AS underutilized FROM rates WHERE brand_users > 12 AND app_open_rate < 10
        ORDER BY brand_users DESC, state, year, brand LIMIT 20""",
        **RATE_CTES,
    ),
)
def _(t):
    return open_rates(t.agg_user, t.map_user, BRAND, min_users=12, max_rate=10)["top"]


@query(
    "ana05_users_map",
    over(
        "top_user_district location",
        f"""SELECT state, district, users, longitude, latitude, {human_double_sql('users')} AS users_f,
        round(CASE WHEN hi = lo THEN 50.0 ELSE (45.0::DOUBLE / (hi - lo)) * (users - lo) + 5 END, 9) AS marker_size
        FROM placed, (SELECT min(users) AS lo, max(users) AS hi FROM placed)""",
        placed=USERS_LOCATION,
    ),
)
def _(t):
    sized = registered_users_map(t.top_user_district, t.location)
    return sized.withColumn("marker_size", F.round("marker_size", 9))


for _output, _view, _place, _limits, _carry in (
    ("states", "map_user", "state", (25, 15), ""),
    ("districts", "top_user_district", "district", (40, 15), "state"),
    ("pincodes", "top_user_pincode", "pincode", (40, 15), "state"),
):
    _sql = top_sql(_view, _place, YEAR, ALL, _limits, _carry)
    _head, _tail = _sql.rsplit("SELECT", 1)

    @query(f"ana06_top_{_output}", f"{_head}SELECT *, {human_double_sql('users')} AS users_f FROM (SELECT{_tail})")
    def _(t, output=_output):
        return top_users(t.map_user, t.top_user_district, t.top_user_pincode, year=YEAR)[output]


# --- payment modes -----------------------------------------------------------

_COUNTS = f"""CAST(sum(transaction_count) AS BIGINT) AS transaction_count,
{money_sql('transaction_amount')} AS transaction_amount"""


def _texts(names: tuple[str, str]) -> str:
    return f"{human_sql('transaction_count')} AS {names[0]}, {human_sql('transaction_amount')} AS {names[1]}"


for _name, _scope in SCOPES.items():
    _view_of = SCOPE_VIEWS[tuple(v != ALL for v in _scope)]
    _where = scope_sql(*_scope)
    _scoped = f"(SELECT * FROM agg_transaction{_where})"

    _totals = gross_sql(_view_of.totals_by, _where) if _view_of.totals_by else f"SELECT {_COUNTS} FROM {_scoped}"

    @query(f"ana07_totals_{_name}", over("agg_transaction", f"SELECT *, {_texts(('count', 'amount'))} FROM ({_totals})"))
    def _(t, scope=_scope):
        return payment_modes(t.agg_transaction, *scope)["totals"]

    _start = ""
    if _view_of.start:
        _column, _value = _view_of.start
        _wanted = f"(SELECT {_value}({_column}) FROM {_scoped})" if _value in ("min", "max") else f"'{_value}'"
        _start = f" WHERE {_column} = {_wanted}"
    _sums = ""
    if _view_of.sum_by is not None:
        _over = f"PARTITION BY {_view_of.sum_by}" if _view_of.sum_by else ""
        _count = f"CAST(sum(transaction_count) OVER ({_over}) AS BIGINT)"
        _amount = f"CAST(sum(CAST(transaction_amount AS DECIMAL(18,2))) OVER ({_over}) AS DOUBLE)"
        _sums = f", {human_sql(_count)} AS count_sum, {human_sql(_amount)} AS amount_sum"

    @query(
        f"ana07_map_start_{_name}",
        over(
            "agg_transaction",
            f"""SELECT * FROM (SELECT *, {_texts(('count', 'amount'))},
            round(ln(1 + transaction_count), 9) AS transaction_count_log{_sums} FROM {_scoped}){_start}""",
        ),
    )
    def _(t, scope=_scope):
        start = payment_modes(t.agg_transaction, *scope)["map_start"]
        return start.withColumn("transaction_count_log", F.round("transaction_count_log", 9))

    _layers = {"count": human_sql("transaction_count"), "amount": human_sql("transaction_amount")}
    _layers |= {c: c for c in _view_of.extra}
    _packed = ", ".join(f"'{k}': {v}" for k, v in _layers.items())
    _shown = ", ".join(f"f.{k} AS {k}" for k in _layers)

    @query(
        f"ana07_types_{_name}",
        over(
            "agg_transaction",
            f"""SELECT x, y, z, {_shown} FROM (SELECT {_view_of.type_x} AS x, transaction_type AS y,
            avg(transaction_count) AS z, arg_min({{{_packed}}}, {{'y': year, 'q': quarter}}) AS f FROM {_scoped} GROUP BY ALL)""",
        ),
    )
    def _(t, scope=_scope, layers=tuple(_layers)):
        return payment_modes(t.agg_transaction, *scope)["type_matrix"]

    if _view_of.grid:
        _x, _y = _view_of.grid
        _keys = "state, year" if _name == "all" else "state, year, quarter"

        @query(
            f"ana07_periods_{_name}",
            over(
                "agg_transaction",
                f"SELECT *, {_texts(('count_s', 'amount_s'))} FROM (SELECT {_keys}, {_COUNTS} FROM {_scoped} GROUP BY ALL)",
            ),
        )
        def _(t, scope=_scope):
            return payment_modes(t.agg_transaction, *scope)["periods"]

        @query(
            f"ana07_grid_{_name}",
            over(
                "agg_transaction",
                f"""SELECT {_x} AS x, {_y} AS y, avg(transaction_count) AS z FROM
                (SELECT {_keys}, {_COUNTS} FROM {_scoped} GROUP BY ALL) GROUP BY ALL""",
            ),
        )
        def _(t, scope=_scope):
            return payment_modes(t.agg_transaction, *scope)["period_matrix"].select("x", "y", "z")


# --- places ------------------------------------------------------------------

for _suffix, _view, _places in (
    ("states", "agg_transaction", ["state"]),
    ("districts", "map_transaction", ["state", "district"]),
    ("pincodes", "top_transaction_pincode", ["state", "pincode"]),
):
    _keys = ", ".join(_places)
    _ranked = f"""SELECT *, {human_double_sql('count')} AS count_f, {human_sql('amount')} AS amount_f,
    row_number() OVER (ORDER BY count DESC, {_keys}) AS r, count(*) OVER () AS n FROM (
    SELECT {_keys}, {YEAR} AS year, CAST(sum(transaction_count) AS BIGINT) AS count,
    {money_sql('transaction_amount')} AS amount FROM {_view} WHERE year = {YEAR} GROUP BY {_keys})"""
    for _output, _rule in (("top", "r <= 10"), ("moderate", "r > 10 AND r <= n - 10"), ("bottom", "r > n - 10")):

        @query(
            f"ana08_{_output}_{_suffix}",
            over(_view, f"SELECT {_keys}, year, count, amount, count_f, amount_f FROM ({_ranked}) WHERE {_rule}"),
        )
        def _(t, view=_view, places=_places, output=_output):
            return volume_places(getattr(t, view), places, YEAR)[output]


@query("ana09_rising_districts", rising_sql(10000, 100))
def _(t):
    return rising_districts(t.map_transaction)


@query("ana10_hierarchy_of_state", _hierarchy(_FULL_PATH, f"WHERE state = '{STATE}'"))
def _(t):
    return volume_hierarchy(t.map_transaction, STATE)


@query(
    "ana10_hierarchy_of_district",
    _hierarchy(_FULL_PATH[1:], f"WHERE state = '{STATE}' AND district = '{DISTRICT}'"),
)
def _(t):
    return volume_hierarchy(t.map_transaction, STATE, DISTRICT)


# --- insurance ---------------------------------------------------------------


@query("ana11_points", over("country_location", "SELECT * FROM country_location"))
def _(t):
    return insurance_hot_spots(t.country_location)["points"]


@query(
    "ana11_center",
    over("country_location", "SELECT avg(latitude) AS latitude, avg(longitude) AS longitude FROM country_location"),
)
def _(t):
    return insurance_hot_spots(t.country_location)["center"]


def _prioritised(t):
    return prioritise_states(t.agg_insurance, t.map_insurance, cur=2000, base=1999, min_growth=5, min_volume=2000)


@query(
    "ana12_states",
    over(
        "agg_insurance map_insurance",
        f"SELECT *, {human_double_sql('total_volume')} AS volume_f FROM ({PRIORITY})",
        growth=GROWTH_SQL,
    ),
)
def _(t):
    return _prioritised(t)["states"]


@query(
    "ana12_tree",
    over(
        "agg_insurance map_insurance",
        f"""SELECT 'States by Category' AS root, CAST(2 - bit_count(GROUPING(state_category, state)) AS INTEGER) AS level,
        state_category, state, count(*) AS members FROM ({PRIORITY}) GROUP BY ROLLUP (state_category, state)""",
        growth=GROWTH_SQL,
    ),
)
def _(t):
    return _prioritised(t)["tree"]


# --- further outputs of the composite analyses --------------------------------

_ENGAGED = f"""SELECT *, {human_double_sql('user_count')} AS user_counts_f, {human_double_sql('open_count')} AS open_counts_f,
round(ln(1 + user_count), 9) AS user_count_log FROM ({STATE_YEAR_USERS})"""


@query("ana02_engagement_map", over("map_user", _ENGAGED))
def _(t):
    return user_engagement(t.map_user, t.map_user)["map"].withColumn("user_count_log", F.round("user_count_log", 9))


@query("ana02_engagement_map_range", over("map_user", f"SELECT min(user_count_log) AS low, max(user_count_log) AS high FROM ({_ENGAGED})"))
def _(t):
    ends = user_engagement(t.map_user, t.map_user)["map_range"]
    return ends.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(
    "ana02_engagement_matrix_range",
    over("map_user", f"SELECT CAST(min(user_count) AS DOUBLE) AS low, CAST(max(user_count) AS DOUBLE) AS high FROM ({STATE_YEAR_USERS})"),
)
def _(t):
    return user_engagement(t.map_user, t.map_user)["matrix_range"]


for _suffix, _year, _quarter in (("every_period", ALL, ALL), ("of_quarters", ALL, "Q4"), ("of_one_quarter", YEAR, "Q4")):
    for _output, _view, _place, _limits, _carry in (
        ("states", "map_user", "state", (25, 15), ""),
        ("districts", "top_user_district", "district", (40, 15), "state"),
        ("pincodes", "top_user_pincode", "pincode", (40, 15), "state"),
    ):
        _head, _tail = top_sql(_view, _place, _year, _quarter, _limits, _carry).rsplit("SELECT", 1)

        @query(
            f"ana06_top_{_output}_{_suffix}",
            f"{_head}SELECT *, {human_double_sql('users')} AS users_f FROM (SELECT{_tail})",
        )
        def _(t, output=_output, scope=(_year, _quarter)):
            return top_users(t.map_user, t.top_user_district, t.top_user_pincode, *scope)[output]


for _name, _scope in SCOPES.items():
    _view_of = SCOPE_VIEWS[tuple(v != ALL for v in _scope)]
    _scoped = f"(SELECT * FROM agg_transaction{scope_sql(*_scope)})"

    @query(f"ana07_rows_{_name}", over("agg_transaction", f"SELECT *, {_texts(('count', 'amount'))} FROM {_scoped}"))
    def _(t, scope=_scope):
        return payment_modes(t.agg_transaction, *scope)["rows"]

    _sums = ""
    if _view_of.sum_by is not None:
        _over = f"PARTITION BY {_view_of.sum_by}" if _view_of.sum_by else ""
        _count = f"CAST(sum(transaction_count) OVER ({_over}) AS BIGINT)"
        _amount = f"CAST(sum(CAST(transaction_amount AS DECIMAL(18,2))) OVER ({_over}) AS DOUBLE)"
        _sums = f", {human_sql(_count)} AS count_sum, {human_sql(_amount)} AS amount_sum"

    @query(
        f"ana07_map_{_name}",
        over(
            "agg_transaction",
            f"""SELECT *, {_texts(('count', 'amount'))}, round(ln(1 + transaction_count), 9) AS transaction_count_log{_sums}
            FROM {_scoped}""",
        ),
    )
    def _(t, scope=_scope):
        mapped = payment_modes(t.agg_transaction, *scope)["map"]
        return mapped.withColumn("transaction_count_log", F.round("transaction_count_log", 9))

    if _view_of.grid:
        _x, _y = _view_of.grid
        _keys = "state, year" if _name == "all" else "state, year, quarter"
        # A cell of the grid is one period, so it has one text per layer.
        _cells = f"""SELECT {_x} AS x, {_y} AS y, CAST(transaction_count AS DOUBLE) AS z, {_texts(('count_s', 'amount_s'))}
        FROM (SELECT {_keys}, {_COUNTS} FROM {_scoped} GROUP BY ALL)"""

        @query(f"ana07_grid_layers_{_name}", over("agg_transaction", _cells))
        def _(t, scope=_scope):
            return payment_modes(t.agg_transaction, *scope)["period_matrix"]

        @query(f"ana07_range_{_name}", over("agg_transaction", f"SELECT min(z) AS low, max(z) AS high FROM ({_cells})"))
        def _(t, scope=_scope):
            return payment_modes(t.agg_transaction, *scope)["period_range"]


for _suffix, _view, _places in (
    ("states", "agg_transaction", ["state"]),
    ("districts", "map_transaction", ["state", "district"]),
    ("pincodes", "top_transaction_pincode", ["state", "pincode"]),
):
    _keys = ", ".join(_places)

    @query(
        f"ana08_all_{_suffix}",
        over(
            _view,
            f"""SELECT *, {human_double_sql('count')} AS count_f, {human_sql('amount')} AS amount_f FROM (
            SELECT {_keys}, CAST(sum(transaction_count) AS BIGINT) AS count, {money_sql('transaction_amount')} AS amount
            FROM {_view} GROUP BY {_keys})""",
        ),
    )
    def _(t, view=_view, places=_places):
        return volume_places(getattr(t, view), places)["all"]
