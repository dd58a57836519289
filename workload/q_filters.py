"""Filters and projections."""

from itertools import product

from pyspark.sql import functions as F

from geotrends.fixed_values import ALL
from geotrends.operators import app_open_rate, filter_place, filter_scope, flag_underutilized, latest_rows
from workload.registry import query
from workload.views import over

STATE, YEAR, QUARTER, BRAND, DISTRICT = "NATION_3", 1998, "Q2", "Brand#7", "MACHINERY"


def scope_sql(state, year, quarter) -> str:
    """WHERE clause of a scope."""
    parts = [f"state = '{state}'"] * (state != ALL) + [f"year = {year}"] * (year != ALL)
    parts += [f"quarter = '{quarter}'"] * (quarter != ALL)
    return " WHERE " + " AND ".join(parts) if parts else ""


SCOPES = {
    "_".join(n for n, on in zip(("state", "year", "quarter"), picks) if on) or "all": tuple(
        v if on else ALL for v, on in zip((STATE, YEAR, QUARTER), picks)
    )
    for picks in product([False, True], repeat=3)
}

for _name, _scope in SCOPES.items():

    @query(f"flt01_scope_{_name}", over("agg_transaction", "SELECT * FROM agg_transaction" + scope_sql(*_scope)))
    def _(t, scope=_scope):
        return filter_scope(t.agg_transaction, *scope)


@query("flt03_year", over("agg_transaction", f"SELECT * FROM agg_transaction WHERE year = {YEAR}"))
def _(t):
    return filter_scope(t.agg_transaction, year=YEAR)


@query(
    "flt04_place",
    over("map_transaction", f"SELECT * FROM map_transaction WHERE state = '{STATE}' AND district = '{DISTRICT}'"),
)
def _(t):
    return filter_place(t.map_transaction, STATE, DISTRICT)


@query("flt05_skip_year", over("agg_user", "SELECT * FROM agg_user WHERE year <> 1999"))
def _(t):
    return t.agg_user.filter(F.col("year") != 1999)


@query(
    "flt06_brand_period",
    over("agg_user", f"SELECT * FROM agg_user WHERE brand = '{BRAND}' AND year = {YEAR} AND quarter = '{QUARTER}'"),
)
def _(t):
    return filter_scope(t.agg_user.filter(F.col("brand") == BRAND), year=YEAR, quarter=QUARTER)


for _how in ("max", "min"):

    @query(
        f"flt07_{_how}_year_rows",
        over("agg_transaction", f"SELECT * FROM agg_transaction WHERE year = (SELECT {_how}(year) FROM agg_transaction)"),
    )
    def _(t, how=_how):
        return latest_rows(t.agg_transaction, "year", how)


@query("flt08_one_quarter", over("agg_transaction", "SELECT * FROM agg_transaction WHERE quarter = 'Q4'"))
def _(t):
    return filter_scope(t.agg_transaction, quarter="Q4")


RATE_CTES = {
    "brands": "SELECT state, year, brand, CAST(sum(user_count) AS BIGINT) AS brand_users FROM agg_user GROUP BY ALL",
    "app_usage": """SELECT state, year, CAST(sum(registered_users) AS BIGINT) AS users,
        CAST(sum(appopen_count) AS BIGINT) AS counts FROM map_user GROUP BY ALL""",
    "rates": """SELECT b.state, b.year, brand, brand_users, users, counts,
        counts / CAST(nullif(brand_users, 0) AS DOUBLE) AS app_open_rate
        FROM brands b JOIN app_usage u ON b.state = u.state AND b.year = u.year""",
}


@query(
    "flt09_underutilized",
    over(
        "agg_user map_user",
        "SELECT *, true AS underutilized FROM rates WHERE brand_users > 12 AND app_open_rate < 10",
        **RATE_CTES,
    ),
)
def _(t):
    return flag_underutilized(app_open_rate(t.agg_user, t.map_user), min_users=12, max_rate=10)


@query(
    "flt09_underutilized_flags",
    over(
        "agg_user map_user",
        "SELECT *, coalesce(brand_users > 12 AND app_open_rate < 10, false) AS underutilized FROM rates",
        **RATE_CTES,
    ),
)
def _(t):
    return flag_underutilized(app_open_rate(t.agg_user, t.map_user), min_users=12, max_rate=10, keep_all=True)


@query(
    "prj01_columns",
    over("country_location", "SELECT state, latitude, longitude, metric FROM country_location"),
)
def _(t):
    return t.country_location.select("state", "latitude", "longitude", "metric")


@query(
    "prj04_pincode_text",
    over("top_user_pincode", "SELECT DISTINCT CAST(CAST(pincode AS BIGINT) AS VARCHAR) AS pincode FROM top_user_pincode"),
)
def _(t):
    return t.base("orders").join(t.base("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(
        F.col("o_custkey").cast("string").alias("pincode")
    ).distinct()
