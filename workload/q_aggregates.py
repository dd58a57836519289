"""Totals, trends, rankings and distinct lists."""

from pyspark.sql import functions as F

from geotrends.operators import (
    centroid,
    children_by_parent,
    children_parts,
    conditional_growth,
    distinct_sorted,
    grand_total,
    iqr_bounds,
    matrix_long,
    one_per_key,
    pad_periods,
    period_totals,
    period_trend,
    rank_places,
    regroup_sum,
    totals_with_gross,
    value_range,
    with_text,
)
from geotrends.operators.aggregates import exact_mean
from geotrends.plans.home import insurance_plot
from geotrends.plans.users import brand_state_year, brand_totals, state_year_users
from geotrends.sources import literal_rows
from workload.q_filters import QUARTER, STATE, YEAR
from workload.registry import query
from workload.views import human_double_sql, human_sql, money_sql, over


def _sum(c: str, name: str) -> str:
    return f"CAST(sum({c}) AS BIGINT) AS {name}"


_TX = f"{_sum('transaction_count', 'count')}, {money_sql('transaction_amount')} AS amount"
_TX_RAW = f"{_sum('transaction_count', 'transaction_count')}, {money_sql('transaction_amount')} AS transaction_amount"


@query("agg01_total_users", over("map_user", f"SELECT {_sum('registered_users', 'total_users')} FROM map_user"))
def _(t):
    return grand_total(t.map_user, {"registered_users": "total_users"})


@query(
    "agg01_total_transactions",
    over("agg_transaction", f"SELECT {_TX} FROM agg_transaction"),
)
def _(t):
    return grand_total(t.agg_transaction, {"transaction_count": "count", "transaction_amount": "amount"})


@query("agg01_total_insurance", over("map_insurance", f"SELECT {_sum('insurance_count', 'total')} FROM map_insurance"))
def _(t):
    return grand_total(t.map_insurance, {"insurance_count": "total"})


@query(
    "agg02_user_trend",
    over(
        "map_user",
        f"SELECT year, quarter, {_sum('registered_users', 'user_count')}, {_sum('appopen_count', 'open_count')} "
        "FROM map_user GROUP BY ALL",
    ),
)
def _(t):
    return period_trend(t.map_user, {"registered_users": "user_count", "appopen_count": "open_count"})


TREND_SQL = over(
    "agg_transaction",
    f"""SELECT *, {human_double_sql('number_of_transactions')} AS number_of_transactions_f,
    {human_sql('total_transaction_amount')} AS total_transaction_amount_f
    FROM (SELECT year, quarter, {_sum('transaction_count', 'number_of_transactions')},
          {money_sql('transaction_amount')} AS total_transaction_amount FROM agg_transaction GROUP BY ALL)""",
)


def transaction_trend(t):
    trend = period_trend(
        t.agg_transaction,
        {"transaction_count": "number_of_transactions", "transaction_amount": "total_transaction_amount"},
    )
    texts = {
        "number_of_transactions": "number_of_transactions_f",
        "total_transaction_amount": "total_transaction_amount_f",
    }
    return with_text(trend, texts, as_double=True)


query("agg03_transaction_trend", TREND_SQL)(transaction_trend)

_INS_TREND = (
    f"SELECT year, quarter, {_sum('insurance_count', 'count')}, {money_sql('insurance_amount')} AS amount "
    "FROM agg_insurance GROUP BY ALL"
)


@query("agg04_insurance_trend", over("agg_insurance", _INS_TREND))
def _(t):
    return period_trend(t.agg_insurance, {"insurance_count": "count", "insurance_amount": "amount"})


STATE_YEAR_USERS = f"""SELECT state, year, {_sum('registered_users', 'user_count')}, {_sum('appopen_count', 'open_count')}
FROM map_user GROUP BY ALL"""


@query(
    "agg05_state_year_users",
    over(
        "map_user",
        f"""SELECT *, {human_double_sql('user_count')} AS user_counts_f, {human_double_sql('open_count')} AS open_counts_f
        FROM ({STATE_YEAR_USERS}) ORDER BY user_count""",
    ),
)
def _(t):
    return state_year_users(t.map_user)


@query(
    "agg06_brand_totals",
    over("agg_user", f"SELECT brand, {_sum('user_count', 'user_count')} FROM agg_user GROUP BY ALL ORDER BY 2"),
)
def _(t):
    return brand_totals(t.agg_user)


@query(
    "agg07_one_per_key",
    over(
        "top_user_pincode",
        "SELECT state, year, quarter, min(registered_users) AS registered_users FROM top_user_pincode GROUP BY ALL",
    ),
)
def _(t):
    return one_per_key(t.top_user_pincode, ["state", "year", "quarter"], "registered_users")


@query(
    "agg07_one_per_key_ordered",
    over(
        "top_transaction_pincode",
        """SELECT state, year, quarter, arg_min(transaction_count, pincode) AS transaction_count
        FROM top_transaction_pincode GROUP BY ALL""",
    ),
)
def _(t):
    return one_per_key(t.top_transaction_pincode, ["state", "year", "quarter"], "transaction_count", ["pincode"])


BRAND_STATE_YEAR = f"SELECT state, year, brand, {_sum('user_count', 'user_count')} FROM agg_user WHERE year <> 1999 GROUP BY ALL"


@query(
    "agg08_brand_state_year",
    over("agg_user", f"SELECT *, {human_sql('user_count')} AS count_f FROM ({BRAND_STATE_YEAR})"),
)
def _(t):
    return brand_state_year(t.agg_user, skipped_year=1999)


@query(
    "agg09_app_usage",
    over(
        "map_user",
        f"SELECT state, year, {_sum('registered_users', 'users')}, {_sum('appopen_count', 'counts')} FROM map_user GROUP BY ALL",
    ),
)
def _(t):
    return regroup_sum(t.map_user, ["state", "year"], {"registered_users": "users", "appopen_count": "counts"})


@query(
    "agg10_district_users",
    over(
        "top_user_district",
        f"SELECT state, district, {_sum('registered_users', 'users')} FROM top_user_district GROUP BY ALL",
    ),
)
def _(t):
    return regroup_sum(t.top_user_district, ["state", "district"], {"registered_users": "users"})


@query("agg11_regroup_state_year", over("agg_transaction", f"SELECT state, year, {_TX_RAW} FROM agg_transaction GROUP BY ALL"))
def _(t):
    return regroup_sum(t.agg_transaction, ["state", "year"], ["transaction_count", "transaction_amount"])


@query(
    "agg12_regroup_state_year_quarter",
    over("agg_transaction", f"SELECT state, year, quarter, {_TX_RAW} FROM agg_transaction GROUP BY ALL"),
)
def _(t):
    return regroup_sum(t.agg_transaction, ["state", "year", "quarter"], ["transaction_count", "transaction_amount"])


for _id, _view, _places in (
    ("agg13_states_by_volume", "agg_transaction", ["state"]),
    ("agg14_districts_by_volume", "map_transaction", ["state", "district"]),
    ("agg15_pincodes_by_volume", "top_transaction_pincode", ["state", "pincode"]),
):
    _keys = ", ".join(_places)

    @query(_id, over(_view, f"SELECT {_keys}, {_TX} FROM {_view} GROUP BY ALL ORDER BY count DESC"))
    def _(t, view=_view, places=_places):
        return rank_places(getattr(t, view), places)

    @query(
        f"{_id}_of_year",
        over(_view, f"SELECT {_keys}, {_TX}, {YEAR} AS year FROM {_view} WHERE year = {YEAR} GROUP BY {_keys}"),
    )
    def _(t, view=_view, places=_places):
        return rank_places(getattr(t, view), places, YEAR)


@query(
    "agg16_district_years",
    over(
        "map_transaction",
        f"SELECT state, year, district, {_sum('transaction_count', 'count')} FROM map_transaction GROUP BY ALL",
    ),
)
def _(t):
    return regroup_sum(t.map_transaction, ["state", "year", "district"], {"transaction_count": "count"})


GROWTH_SQL = """SELECT state, count_2000, count_1999,
round((count_2000 - count_1999) * 100.0::DOUBLE / nullif(count_1999, 0), 2) AS growth_percent FROM (
  SELECT state, CAST(sum(CASE WHEN year = 2000 THEN insurance_count ELSE 0 END) AS BIGINT) AS count_2000,
         CAST(sum(CASE WHEN year = 1999 THEN insurance_count ELSE 0 END) AS BIGINT) AS count_1999
  FROM agg_insurance GROUP BY state)"""


@query("agg17_conditional_growth", over("agg_insurance", GROWTH_SQL))
def _(t):
    return conditional_growth(t.agg_insurance, cur=2000, base=1999)


@query(
    "agg18_state_volume",
    over("map_insurance", f"SELECT state, {_sum('insurance_count', 'total_volume')} FROM map_insurance GROUP BY ALL"),
)
def _(t):
    return regroup_sum(t.map_insurance, ["state"], {"insurance_count": "total_volume"})


def gross_sql(by: str, where: str = "", source: str = "agg_transaction") -> str:
    """Totals per listed period (zero where none) and the gross total."""
    return f"""
    SELECT CAST(p.{by} AS VARCHAR) AS scope, CAST(coalesce(sum(transaction_count), 0) AS BIGINT) AS transaction_count,
           coalesce({money_sql('transaction_amount')}, 0) AS transaction_amount
    FROM (SELECT DISTINCT {by} FROM {source}) p LEFT JOIN (SELECT * FROM {source} {where}) s ON p.{by} = s.{by} GROUP BY p.{by}
    UNION ALL
    SELECT 'Gross', CAST(coalesce(sum(transaction_count), 0) AS BIGINT), coalesce({money_sql('transaction_amount')}, 0)
    FROM {source} {where}"""


@query("agg19_totals_by_year", over("agg_transaction", gross_sql("year")))
def _(t):
    return totals_with_gross(t.agg_transaction, "year", ["transaction_count", "transaction_amount"])


@query("agg20_totals_by_quarter", over("agg_transaction", gross_sql("quarter", f"WHERE year = {YEAR}")))
def _(t):
    scoped = t.agg_transaction.filter(F.col("year") == YEAR)
    return totals_with_gross(scoped, "quarter", ["transaction_count", "transaction_amount"], t.agg_transaction)


@query(
    "agg21_scope_total",
    over("agg_transaction", f"SELECT {_TX_RAW} FROM agg_transaction WHERE state = '{STATE}' AND quarter = '{QUARTER}'"),
)
def _(t):
    scoped = t.agg_transaction.filter((F.col("state") == STATE) & (F.col("quarter") == QUARTER))
    return grand_total(scoped, ["transaction_count", "transaction_amount"])


@query("agg22_states", over("agg_transaction", "SELECT DISTINCT state FROM agg_transaction ORDER BY 1"))
def _(t):
    return distinct_sorted(t.agg_transaction, "state")


@query("agg22_quarters", over("agg_transaction", "SELECT DISTINCT quarter FROM agg_transaction ORDER BY 1"))
def _(t):
    return distinct_sorted(t.agg_transaction, "quarter")


@query("agg23_years", over("agg_transaction", "SELECT DISTINCT year FROM agg_transaction ORDER BY 1"))
def _(t):
    return distinct_sorted(t.agg_transaction, "year")


@query("agg23_brands", over("agg_user", "SELECT DISTINCT brand FROM agg_user ORDER BY 1"))
def _(t):
    return distinct_sorted(t.agg_user, "brand")


@query(
    "agg24_districts_of_state",
    over(
        "map_transaction",
        """SELECT state, string_agg(district, '|' ORDER BY district) AS districts
        FROM (SELECT DISTINCT state, district FROM map_transaction) GROUP BY state""",
    ),
)
def _(t):
    lists = children_by_parent(t.map_transaction)
    return lists.withColumn("districts", F.array_join("districts", "|"))


@query(
    "agg25_value_range",
    over("agg_transaction", "SELECT min(transaction_amount) AS low, max(transaction_amount) AS high FROM agg_transaction"),
)
def _(t):
    return value_range(t.agg_transaction, "transaction_amount")


@query(
    "agg25_matrix_range",
    over(
        "agg_transaction",
        """SELECT min(z) AS low, max(z) AS high FROM (SELECT state, transaction_type, avg(transaction_count) AS z
        FROM agg_transaction GROUP BY ALL)""",
    ),
)
def _(t):
    return value_range(matrix_long(t.agg_transaction, "state", "transaction_type", "transaction_count"), "z")


@query(
    "agg26_centroid",
    over("country_location", "SELECT avg(latitude) AS latitude, avg(longitude) AS longitude FROM country_location"),
)
def _(t):
    return centroid(t.country_location)


def _iqr_sql(c: str, source: str, by: str = "") -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {keys}round(q[1], 6) AS q1, round(q[2], 6) AS q2, round(q[3], 6) AS q3,
    CAST(trunc(q[2]) AS BIGINT) AS median, CAST(trunc(q[1] - 1.5 * (q[3] - q[1])) AS BIGINT) AS lower,
    CAST(trunc(q[3] + 1.5 * (q[3] - q[1])) AS BIGINT) AS upper
    FROM (SELECT {keys}quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM {source} {group})"""


def _rounded(df):
    return df.withColumns({q: F.round(q, 6) for q in ("q1", "q2", "q3")})


@query("agg27_iqr_bounds", over("top_transaction_pincode", _iqr_sql("transaction_amount", "top_transaction_pincode")))
def _(t):
    return _rounded(iqr_bounds(t.top_transaction_pincode, "transaction_amount"))


@query("agg27_iqr_bounds_by_state", over("agg_user", _iqr_sql("user_count", "agg_user", "state")))
def _(t):
    return _rounded(iqr_bounds(t.agg_user, "user_count", by=["state"]))


@query("agg27_iqr_bounds_of_prices", _iqr_sql("l_extendedprice", "lineitem", "l_returnflag"))
def _(t):
    return _rounded(iqr_bounds(t.base("lineitem"), "l_extendedprice", by=["l_returnflag"]))


@query(
    "jon04_period_totals",
    over(
        "agg_transaction",
        f"""SELECT p.year, CAST(coalesce(sum(transaction_count), 0) AS BIGINT) AS transaction_count
        FROM (SELECT DISTINCT year FROM agg_transaction) p LEFT JOIN
        (SELECT * FROM agg_transaction WHERE state = '{STATE}' AND quarter = 'Q4') s ON p.year = s.year GROUP BY p.year""",
    ),
)
def _(t):
    scoped = t.agg_transaction.filter((F.col("state") == STATE) & (F.col("quarter") == "Q4"))
    return period_totals(scoped, t.years, "year", ["transaction_count"])


@query(
    "set01_pad_periods",
    over(
        "agg_insurance",
        f"SELECT 1994 AS year, 'Q1' AS quarter, 0::BIGINT AS count, 0::DOUBLE AS amount UNION ALL {_INS_TREND}",
    ),
)
def _(t):
    trend = period_trend(t.agg_insurance, {"insurance_count": "count", "insurance_amount": "amount"})
    first = literal_rows(t.spark, [(1994, "Q1", 0, 0.0)], trend.schema)
    return pad_periods(trend, first)


@query(
    "set01_insurance_plot",
    over(
        "agg_insurance",
        f"""SELECT *, {human_double_sql('count')} AS count_f, {human_sql('amount')} AS amount_f FROM (
        SELECT 2020 AS year, 'Q1' AS quarter, 0::BIGINT AS count, 0::DOUBLE AS amount UNION ALL {_INS_TREND})""",
    ),
)
def _(t):
    return insurance_plot(period_trend(t.agg_insurance, {"insurance_count": "count", "insurance_amount": "amount"}))


@query("set02_distinct_pairs", over("map_transaction", "SELECT DISTINCT state, district FROM map_transaction"))
def _(t):
    return distinct_sorted(t.map_transaction, "state", "district")


def _six(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


@query(
    "agg11_discounts",
    """SELECT l_returnflag, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))), 6)::DOUBLE
    AS discount FROM lineitem GROUP BY l_returnflag""",
)
def _(t):
    line = t.base("lineitem").select("l_returnflag", (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"))
    return regroup_sum(line, ["l_returnflag"], ["discount"]).withColumns(_six("discount"))


@query(
    "agg11_mean_share_by_brand",
    over("agg_user", "SELECT brand, round(avg(user_percentage), 6) AS share FROM agg_user GROUP BY brand"),
)
def _(t):
    means = t.agg_user.groupBy("brand").agg(exact_mean(t.agg_user, "user_percentage").alias("share"))
    return means.withColumns(_six("share"))


@query(
    "agg11_coordinate_sums",
    over(
        "location",
        """SELECT state, round(sum(latitude) / 3, 6) AS latitude, round(sum(longitude / 3), 6) AS longitude
        FROM location GROUP BY state""",
    ),
)
def _(t):
    thirds = t.location.withColumn("longitude", F.col("longitude") / 3)
    sums = regroup_sum(thirds, ["state"], ["latitude", "longitude"])
    return sums.withColumn("latitude", F.col("latitude") / 3).withColumns(_six("latitude", "longitude"))


@query(
    "agg24_children_in_parts",
    over(
        "top_transaction_pincode",
        """SELECT state, CAST(place - min(place) OVER (PARTITION BY state) AS INTEGER) AS part, pincodes FROM (
          SELECT state, place, array_to_string(list(pincode ORDER BY pincode), ' ') AS pincodes FROM (
            SELECT state, pincode, (row_number() OVER (ORDER BY state, pincode) - 1) // 16 AS place
            FROM (SELECT DISTINCT state, pincode FROM top_transaction_pincode)) GROUP BY state, place)""",
    ),
)
def _(t):
    parts = children_parts(t.top_transaction_pincode, "state", "pincode", size=16)
    return parts.withColumn("pincodes", F.array_join("pincodes", " "))
