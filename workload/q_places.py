"""Joins, windows, rankings, matrices and hierarchies."""

from pyspark.sql import functions as F

from geotrends.fixed_values import ALL, SEGMENTS
from geotrends.fixed_values import SEGMENTS
from geotrends.operators import (
    app_open_rate,
    category_tree,
    conditional_growth,
    head_n,
    hierarchy_rollup,
    join_boundaries,
    matrix,
    matrix_long,
    middle_slice,
    order_by_category,
    place_sums,
    regroup_sum,
    rising_places,
    state_priority,
    tail_n,
    top_places,
    unmatched_names,
    users_with_location,
    with_previous,
    with_text,
    with_total,
)
from workload.q_aggregates import GROWTH_SQL
from workload.q_filters import QUARTER, RATE_CTES, STATE, YEAR, scope_sql
from workload.registry import query
from workload.views import human_sql, money_sql, over

# --- joins -------------------------------------------------------------------


@query("jon01_app_open_rate", over("agg_user map_user", "SELECT * FROM rates", **RATE_CTES))
def _(t):
    return app_open_rate(t.agg_user, t.map_user)


USERS_LOCATION = """SELECT u.state, u.district, users, spot.longitude AS longitude, spot.latitude AS latitude FROM
(SELECT state, district, CAST(sum(registered_users) AS BIGINT) AS users FROM top_user_district GROUP BY ALL) u JOIN
(SELECT state, district, min({'longitude': longitude, 'latitude': latitude}) AS spot FROM location GROUP BY ALL) l
ON u.state = l.state AND u.district = l.district"""


@query("jon02_users_with_location", over("top_user_district location", USERS_LOCATION))
def _(t):
    return users_with_location(t.top_user_district, t.location)


_BEST, _SATURATED, _RISING, _IDLE = (f"'{name}'" for name in SEGMENTS)
# Two rules (fast: more than 5 percent, large: more than 2000) and the name of each combination;
# a volume on the bound and an unknown growth have none.
PRIORITY = f"""WITH totals AS (
  SELECT state, CAST(sum(insurance_count) AS BIGINT) AS volume FROM map_insurance GROUP BY state),
judged AS (
  SELECT growth.*, volume, growth_percent > 5 AS fast, CASE WHEN volume <> 2000 THEN volume > 2000 END AS large
  FROM growth JOIN totals USING (state)),
names(fast, large, name) AS (
  VALUES (true, true, {_BEST}), (false, true, {_SATURATED}), (true, false, {_RISING}), (false, false, {_IDLE}))
SELECT state, growth_percent, volume AS total_volume, coalesce(name, {_IDLE}) AS state_category
FROM judged LEFT JOIN names USING (fast, large)"""


def _priority(t):
    growth = conditional_growth(t.agg_insurance, cur=2000, base=1999)
    return state_priority(growth, t.map_insurance, min_growth=5, min_volume=2000)


query(
    "jon03_state_priority",
    over("agg_insurance map_insurance", f"SELECT * FROM ({PRIORITY})", growth=GROWTH_SQL),
)(_priority)


def _boundaries(t):
    """One shape per nation; some under a name that no row has."""
    nation = t.base("nation")
    name = F.when(F.col("n_regionkey") != 4, F.col("n_name")).otherwise(F.concat(F.lower("n_name"), F.lit("_isles")))
    corner = F.struct(F.lit("Point").alias("type"), F.array("n_nationkey", "n_regionkey").alias("coordinates"))
    return nation.select(name.alias("name"), F.to_json(corner).alias("geometry_json"))


_SHAPES = """SELECT CASE WHEN n_regionkey <> 4 THEN n_name ELSE lower(n_name) || '_isles' END AS name,
'{"type":"Point","coordinates":[' || n_nationkey || ',' || n_regionkey || ']}' AS geometry_json FROM nation"""
_STATE_TOTALS = "SELECT state, CAST(sum(transaction_count) AS BIGINT) AS transaction_count FROM agg_transaction GROUP BY ALL"


@query(
    "jon05_join_boundaries",
    over(
        "agg_transaction",
        f"SELECT state, transaction_count, geometry_json FROM ({_STATE_TOTALS}) d JOIN shapes ON state = name",
        shapes=_SHAPES,
    ),
)
def _(t):
    totals = regroup_sum(t.agg_transaction, ["state"], ["transaction_count"])
    return join_boundaries(totals, _boundaries(t))


@query(
    "jon05_unmatched_names",
    over(
        "agg_transaction",
        """SELECT DISTINCT state AS name, 'data' AS side FROM agg_transaction WHERE state NOT IN (SELECT name FROM shapes)
        UNION ALL SELECT name, 'boundary' FROM shapes WHERE name NOT IN (SELECT state FROM agg_transaction)""",
        shapes=_SHAPES,
    ),
)
def _(t):
    return unmatched_names(t.agg_transaction, _boundaries(t))


@query("flt11_one_boundary", f"SELECT * FROM ({_SHAPES}) WHERE name = '{STATE}'")
def _(t):
    return _boundaries(t).filter(F.col("name") == STATE)


# --- windows -----------------------------------------------------------------

_YEARLY = "SELECT state, year, district, CAST(sum(transaction_count) AS BIGINT) AS count FROM map_transaction GROUP BY ALL"


@query(
    "win01_previous_year",
    over(
        "map_transaction",
        f"""SELECT *, lag(count) OVER (PARTITION BY state, district ORDER BY year) AS prev_year_count FROM ({_YEARLY})""",
    ),
)
def _(t):
    yearly = regroup_sum(t.map_transaction, ["state", "year", "district"], {"transaction_count": "count"})
    return with_previous(yearly, ["state", "district"], "year", "count", "prev_year_count")


def rising_sql(max_prev: float, min_growth: float) -> str:
    return over(
        "map_transaction",
        f"""SELECT *, state || ' - ' || year AS state_year FROM (
        SELECT *, CASE WHEN prev_year_count = 0 THEN CASE WHEN count > 0 THEN 'Infinity'::DOUBLE END
                       ELSE (count - prev_year_count) / CAST(prev_year_count AS DOUBLE) * 100 END AS growth_percentage
        FROM (SELECT *, lag(count) OVER (PARTITION BY state, district ORDER BY year) AS prev_year_count FROM ({_YEARLY})))
        WHERE prev_year_count < {max_prev} AND growth_percentage > {min_growth} ORDER BY growth_percentage DESC""",
    )


@query("win02_rising_places", rising_sql(10000, 100))
def _(t):
    return rising_places(t.map_transaction)


@query("win02_rising_places_low_bar", rising_sql(50, 10))
def _(t):
    return rising_places(t.map_transaction, max_prev=50, min_growth=10)


@query(
    "win03_frame_total",
    over(
        "agg_transaction",
        f"""SELECT *, (SELECT {money_sql('transaction_amount')} FROM agg_transaction) AS amount_sum FROM agg_transaction""",
    ),
)
def _(t):
    return with_total(t.agg_transaction, {"transaction_amount": "amount_sum"})


for _id, _by in (("win04_year_total", "year"), ("win05_quarter_total", "quarter")):

    @query(
        _id,
        over(
            "agg_transaction",
            f"""SELECT *, CAST(sum(transaction_count) OVER (PARTITION BY {_by}) AS BIGINT) AS count_sum,
            CAST(sum(CAST(transaction_amount AS DECIMAL(18,2))) OVER (PARTITION BY {_by}) AS DOUBLE) AS amount_sum
            FROM agg_transaction""",
        ),
    )
    def _(t, by=_by):
        return with_total(t.agg_transaction, {"transaction_count": "count_sum", "transaction_amount": "amount_sum"}, by)


# --- rankings ----------------------------------------------------------------


def top_sql(view: str, place: str, year, quarter, limits, carry: str = "", by_state: bool = False) -> str:
    period = ["year", "quarter"] if year != ALL or quarter != ALL else []
    keys = (["state"] if by_state else []) + [place] + period
    n = limits[0] if (year == ALL) != (quarter == ALL) else limits[1]
    shown = "" if not carry or carry in keys else f"min({carry}) AS {carry}, "
    cols = ", ".join(keys)
    return over(
        view,
        f"""SELECT {cols}, {shown}CAST(sum(registered_users) AS BIGINT) AS users FROM {view}{scope_sql(ALL, year, quarter)}
        GROUP BY {cols} ORDER BY users DESC, {cols} LIMIT {n}""",
    )


_PERIODS = {"all": (ALL, ALL), "year": (YEAR, ALL), "quarter": (ALL, QUARTER), "year_quarter": (YEAR, QUARTER)}
for _id, _view, _place, _limits, _carry in (
    ("top01_states", "map_user", "state", (25, 15), ""),
    ("top02_districts", "top_user_district", "district", (40, 15), "state"),
    ("top03_pincodes", "top_user_pincode", "pincode", (40, 15), "state"),
):
    for _name, (_year, _quarter) in _PERIODS.items():

        @query(f"{_id}_{_name}", top_sql(_view, _place, _year, _quarter, _limits, _carry))
        def _(t, view=_view, place=_place, year=_year, quarter=_quarter, carry=_carry):
            return top_places(getattr(t, view), [place], year, quarter, carry=carry or None)


@query(
    "top02_districts_by_state",
    top_sql("top_user_district", "district", YEAR, ALL, (40, 15), by_state=True),
)
def _(t):
    return top_places(t.top_user_district, ["district"], YEAR, by_state=True)


_RANKED = f"""SELECT {{keys}}, CAST(sum(transaction_count) AS BIGINT) AS count, {money_sql('transaction_amount')} AS amount
FROM {{view}} GROUP BY {{keys}}"""

for _suffix, _view, _places in (
    ("states", "agg_transaction", ["state"]),
    ("districts", "map_transaction", ["state", "district"]),
    ("pincodes", "top_transaction_pincode", ["state", "pincode"]),
):
    _keys = ", ".join(_places)
    _ranked = _RANKED.format(keys=_keys, view=_view)
    _desc = ", ".join(f"{p} DESC" for p in _places)

    @query(f"top04_head_{_suffix}", over(_view, f"{_ranked} ORDER BY count DESC, {_keys} LIMIT 10"))
    def _(t, view=_view, places=_places):
        return head_n(place_sums(getattr(t, view), places), "count", places)

    @query(
        f"top05_middle_{_suffix}",
        over(
            _view,
            f"""SELECT {_keys}, count, amount FROM (SELECT *, row_number() OVER (ORDER BY count DESC, {_keys}) AS r,
            count(*) OVER () AS n FROM ({_ranked})) WHERE r > 10 AND r <= n - 10""",
        ),
    )
    def _(t, view=_view, places=_places):
        return middle_slice(place_sums(getattr(t, view), places), "count", places)

    @query(f"top06_tail_{_suffix}", over(_view, f"{_ranked} ORDER BY count, {_desc} LIMIT 10"))
    def _(t, view=_view, places=_places):
        return tail_n(place_sums(getattr(t, view), places), "count", places)


@query(
    "top07_largest_underutilized",
    over(
        "agg_user map_user",
        """SELECT state, year, brand, brand_users, app_open_rate FROM rates WHERE brand_users > 12 AND app_open_rate < 10
        ORDER BY brand_users DESC, state, year, brand LIMIT 20""",
        **RATE_CTES,
    ),
)
def _(t):
    from geotrends.operators import flag_underutilized

    under = flag_underutilized(app_open_rate(t.agg_user, t.map_user), min_users=12, max_rate=10)
    top = head_n(under, "brand_users", ["state", "year", "brand"], 20)
    return top.select("state", "year", "brand", "brand_users", "app_open_rate")


@query(
    "srt01_ascending",
    over(
        "map_user",
        """SELECT state, CAST(sum(registered_users) AS BIGINT) AS users FROM map_user GROUP BY ALL
        ORDER BY users DESC, state LIMIT 15""",
    ),
)
def _(t):
    return top_places(t.map_user, ["state"]).orderBy("users", F.desc("state"))


@query(
    "srt04_category_order",
    over("agg_insurance map_insurance", f"SELECT * FROM ({PRIORITY})", growth=GROWTH_SQL),
)
def _(t):
    return order_by_category(_priority(t), "state_category", SEGMENTS, "state")


# --- matrices ----------------------------------------------------------------

_REGROUPED = f"""SELECT state, year, CAST(sum(transaction_count) AS BIGINT) AS transaction_count,
{money_sql('transaction_amount')} AS transaction_amount FROM agg_transaction GROUP BY ALL"""
_NATIONS = [f"NATION_{i}" for i in range(25)]
_YEARS = list(range(1995, 2002))
_QUARTERS = ["Q1", "Q2", "Q3", "Q4"]
_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _wide(index: str, column: str, values, source: str) -> str:
    cells = ", ".join(f"""avg(CASE WHEN {column} = '{v}' THEN transaction_count END) AS "{v}" """ for v in values)
    return f"SELECT {index}, {cells} FROM {source} GROUP BY {index}"


@query("piv01_year_by_state", over("agg_transaction", _wide("year", "state", _NATIONS, f"({_REGROUPED})")))
def _(t):
    sums = regroup_sum(t.agg_transaction, ["state", "year"], ["transaction_count"])
    return matrix(sums, "year", "state", "transaction_count", values=_NATIONS)


_BY_QUARTER = """SELECT state, year, quarter, CAST(sum(transaction_count) AS BIGINT) AS transaction_count
FROM agg_transaction {0} GROUP BY ALL"""


@query(
    "piv02_quarter_by_state",
    over("agg_transaction", _wide("quarter", "state", _NATIONS, f"({_BY_QUARTER.format(f'WHERE year = {YEAR}')})")),
)
def _(t):
    scoped = t.agg_transaction.filter(F.col("year") == YEAR)
    sums = regroup_sum(scoped, ["state", "year", "quarter"], ["transaction_count"])
    return matrix(sums, "quarter", "state", "transaction_count", values=_NATIONS)


_ONE_STATE = _BY_QUARTER.format(f"WHERE state = '{STATE}'")


@query("piv03_quarter_by_year", over("agg_transaction", _wide("quarter", "year", _YEARS, f"({_ONE_STATE})")))
def _(t):
    scoped = t.agg_transaction.filter(F.col("state") == STATE)
    sums = regroup_sum(scoped, ["state", "year", "quarter"], ["transaction_count"])
    return matrix(sums, "quarter", "year", "transaction_count", values=_YEARS)


@query("piv04_year_by_quarter", over("agg_transaction", _wide("year", "quarter", _QUARTERS, f"({_ONE_STATE})")))
def _(t):
    scoped = t.agg_transaction.filter(F.col("state") == STATE)
    sums = regroup_sum(scoped, ["state", "year", "quarter"], ["transaction_count"])
    return matrix(sums, "year", "quarter", "transaction_count", values=_QUARTERS)


@query("piv05_type_by_state", over("agg_transaction", _wide("transaction_type", "state", _NATIONS, "agg_transaction")))
def _(t):
    return matrix(t.agg_transaction, "transaction_type", "state", "transaction_count", values=_NATIONS)


@query("piv06_type_by_year", over("agg_transaction", _wide("transaction_type", "year", _YEARS, "agg_transaction")))
def _(t):
    return matrix(t.agg_transaction, "transaction_type", "year", "transaction_count", values=_YEARS)


@query("piv07_type_by_quarter", over("agg_transaction", _wide("transaction_type", "quarter", _QUARTERS, "agg_transaction")))
def _(t):
    return matrix(t.agg_transaction, "transaction_type", "quarter", "transaction_count", values=_QUARTERS)


@query(
    "piv07_columns_found",
    over("agg_transaction", _wide("transaction_type", "quarter", _QUARTERS, "agg_transaction")),
)
def _(t):
    return matrix(t.agg_transaction, "transaction_type", "quarter", "transaction_count")


_FIRST_CELLS = ", ".join(
    f"""arg_min(CASE WHEN transaction_type = '{v}' THEN text END, CASE WHEN transaction_type = '{v}' THEN
    {{'y': year, 'q': quarter}} END) AS "{v}" """
    for v in _TYPES
)


@query(
    "piv08_first_text",
    over(
        "agg_transaction",
        f"""SELECT state, {_FIRST_CELLS} FROM (SELECT *, {human_sql('transaction_amount')} AS text FROM agg_transaction)
        GROUP BY state""",
    ),
)
def _(t):
    texts = with_text(t.agg_transaction, {"transaction_amount": "text"})
    return matrix(texts, "state", "transaction_type", "text", agg="first", values=_TYPES, order=["year", "quarter"])


@query(
    "piv09_long_cells",
    over(
        "agg_transaction",
        f"""SELECT x, y, z, f.c AS count, f.a AS amount, f.y AS year, f.q AS quarter FROM (
        SELECT state AS x, transaction_type AS y, avg(transaction_count) AS z,
        arg_min({{'c': {human_sql('transaction_count')}, 'a': {human_sql('transaction_amount')}, 'y': year, 'q': quarter}},
                {{'y': year, 'q': quarter}}) AS f FROM agg_transaction GROUP BY ALL)""",
    ),
)
def _(t):
    texts = with_text(t.agg_transaction, {"transaction_count": "count", "transaction_amount": "amount"})
    return matrix_long(
        texts,
        "state",
        "transaction_type",
        "transaction_count",
        layers=["count", "amount", "year", "quarter"],
        order=["year", "quarter"],
    )


@query(
    "piv09_long_sums",
    over(
        "map_transaction",
        f"SELECT state AS x, district AS y, {money_sql('transaction_amount')} AS z FROM map_transaction GROUP BY ALL",
    ),
)
def _(t):
    return matrix_long(t.map_transaction, "state", "district", "transaction_amount", agg="sum")


# --- hierarchies -------------------------------------------------------------


def hierarchy_sql(path: list[str], source: str, value: str, square: str) -> str:
    """Rollup with shares; the parent of a node is the node one key shorter. ``value`` and ``square`` are sums."""
    n = len(path)
    keys = ", ".join(path)
    match = " AND ".join(
        f"p.{c} IS NOT DISTINCT FROM CASE WHEN c.level > {i} THEN c.{c} END" for i, c in enumerate(path, start=1)
    )
    return f"""WITH nodes AS (SELECT {n} - bit_count(GROUPING({keys})) AS level, {keys}, {value} AS value,
      CAST({square} AS DOUBLE) / nullif(CAST({value} AS DOUBLE), 0) AS weighted
      FROM {source} GROUP BY ROLLUP ({keys}))
    SELECT CAST(c.level AS INTEGER) AS level, {", ".join(f"c.{k}" for k in path)}, c.value, c.weighted,
      c.value / CAST(CASE WHEN c.level = 0 THEN c.value ELSE p.value END AS DOUBLE) AS pct_parent,
      c.value / CAST((SELECT value FROM nodes WHERE level = 0) AS DOUBLE) AS pct_root
    FROM nodes c LEFT JOIN nodes p ON p.level = c.level - 1 AND {match}"""


_COUNTS = ("CAST(sum(transaction_count) AS BIGINT)", "sum(transaction_count * transaction_count)")
_CENTS = "CAST(transaction_amount AS DECIMAL(18,2))"


def _hierarchy(path, where="", sums=_COUNTS):
    body = hierarchy_sql(path, f"(SELECT * FROM map_transaction {where})", *sums)
    # The nodes join the other CTEs.
    nodes, rest = body.removeprefix("WITH nodes AS (").split("\n    SELECT CAST(c.level", 1)
    return over("map_transaction", "SELECT CAST(c.level" + rest, nodes=nodes.rstrip()[:-1])


_FULL_PATH = ["state", "district", "year", "quarter"]


@query("agg28_hierarchy", _hierarchy(_FULL_PATH))
def _(t):
    return hierarchy_rollup(t.map_transaction, _FULL_PATH, "transaction_count")


# Squares of amounts differ in their last digits between decimals and doubles.
_AMOUNTS = _hierarchy(_FULL_PATH, sums=(money_sql("transaction_amount"), f"sum({_CENTS} * {_CENTS})"))


@query("agg28_hierarchy_of_amount", _AMOUNTS.replace("c.value, c.weighted", "c.value, round(c.weighted, 3) AS weighted"))
def _(t):
    nodes = hierarchy_rollup(t.map_transaction, _FULL_PATH, "transaction_amount")
    return nodes.withColumn("weighted", F.round("weighted", 3))


@query("agg29_hierarchy_of_district", _hierarchy(_FULL_PATH[1:], f"WHERE state = '{STATE}'"))
def _(t):
    return hierarchy_rollup(t.map_transaction.filter(F.col("state") == STATE), _FULL_PATH[1:], "transaction_count")


@query(
    "agg30_weighted_mean",
    over(
        "map_transaction",
        """SELECT state, CAST(sum(transaction_count * transaction_count) AS DOUBLE) / CAST(sum(transaction_count) AS DOUBLE)
        AS weighted FROM map_transaction GROUP BY state""",
    ),
)
def _(t):
    nodes = hierarchy_rollup(t.map_transaction, _FULL_PATH, "transaction_count")
    return nodes.filter(F.col("level") == 1).select("state", "weighted")


@query(
    "win06_share_of_parent",
    over(
        "map_transaction",
        """SELECT state, district, value / CAST(sum(value) OVER (PARTITION BY state) AS DOUBLE) AS pct_parent,
        value / CAST(sum(value) OVER () AS DOUBLE) AS pct_root
        FROM (SELECT state, district, sum(transaction_count) AS value FROM map_transaction GROUP BY ALL)""",
    ),
)
def _(t):
    nodes = hierarchy_rollup(t.map_transaction, _FULL_PATH, "transaction_count")
    return nodes.filter(F.col("level") == 2).select("state", "district", "pct_parent", "pct_root")


@query(
    "agg31_category_tree",
    over(
        "agg_insurance map_insurance",
        f"""SELECT 'States by Category' AS root, CAST(2 - bit_count(GROUPING(state_category, state)) AS INTEGER) AS level,
        state_category, state, count(*) AS members FROM ({PRIORITY}) GROUP BY ROLLUP (state_category, state)""",
        growth=GROWTH_SQL,
    ),
)
def _(t):
    return category_tree(_priority(t))
