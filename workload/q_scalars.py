"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from geotrends.functions import (
    canonical_state,
    clean_district,
    clean_state_label,
    human_number,
    pct_change,
    place_year_label,
    quarter_tag,
    round2,
    safe_ratio,
    segment,
    title_case,
    truncate_int,
)
from geotrends.operators import period_trend, rescale, with_log, with_text
from workload.registry import query
from workload.views import human_double_sql, human_sql, over

# Multipliers that spread prices over every unit of the number text.
_SPREAD_SQL = "o_totalprice * power(10, (o_orderkey % 10) - 3)"


@query(
    "scl01_human_number",
    f"""SELECT o_orderkey, {human_sql('x')} AS price_text, {human_sql('n')} AS count_text
    FROM (SELECT o_orderkey, round({_SPREAD_SQL}, 3) AS x, o_orderkey * o_custkey AS n FROM orders)""",
)
def _(t):
    spread = F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 10 - 3)
    rows = t.base("orders").select(
        "o_orderkey", F.round(spread, 3).alias("x"), (F.col("o_orderkey") * F.col("o_custkey")).alias("n")
    )
    return with_text(rows, {"x": "price_text", "n": "count_text"}).drop("x", "n")


_WIDE_SQL = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN -1 ELSE 1 END * (1 + o_custkey % 9)
* CAST('1e' || (o_orderkey % 44 - 8) AS DOUBLE) AS x FROM orders"""


@query("scl01_human_number_wide", f"SELECT o_orderkey, {human_sql('x')} AS text FROM ({_WIDE_SQL})")
def _(t):
    """Numbers from 1e-8 to 9e35 and negative ones."""
    power = F.concat(F.lit("1e"), (F.col("o_orderkey") % 44 - 8).cast("string")).cast("double")
    sign = F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    rows = t.base("orders").select("o_orderkey", (sign * (1 + F.col("o_custkey") % 9) * power).alias("x"))
    return with_text(rows, {"x": "text"}).drop("x")


# A sharp s has no single capital in this rule: it becomes "Ss" at the start of a word.
_TITLE_SQL = (
    "array_to_string(list_transform(regexp_extract_all(lower({0}), '(\\p{{L}}+|\\P{{L}}+)'), "
    "lambda w: CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END || w[2:]), '')"
)


@query(
    "scl01_human_number_expression",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, {human_sql('l_extendedprice')} AS price_text FROM lineitem",
)
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return t.base("lineitem").select(*keys, human_number(F.col("l_extendedprice")).alias("price_text"))


@query(
    "scl02_canonical_state",
    f"""SELECT c_custkey, CASE WHEN s LIKE 'Andaman%' THEN 'Andaman & Nicobar' WHEN s LIKE 'Jammu%' THEN 'Jammu & Kashmir'
    WHEN s LIKE 'Dadra%' THEN 'Dadra and Nagar Haveli and Daman and Diu' ELSE s END AS state
    FROM (SELECT c_custkey, replace({_TITLE_SQL.format('raw')}, '-', ' ') AS s FROM (
      SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'andaman-&-' WHEN 1 THEN 'jammu-&-' WHEN 2 THEN 'dadra-' ELSE '' END
        || replace(lower(c_mktsegment || '-' || c_name), '#', '-') AS raw FROM customer))""",
)
def _(t):
    prefix = F.element_at(
        F.array(*[F.lit(x) for x in ("andaman-&-", "jammu-&-", "dadra-", "", "")]), (F.col("c_custkey") % 5 + 1).cast("int")
    )
    raw = F.concat(prefix, F.replace(F.lower(F.concat_ws("-", "c_mktsegment", "c_name")), F.lit("#"), F.lit("-")))
    return t.base("customer").select("c_custkey", canonical_state(raw).alias("state"))


@query(
    "scl03_clean_district",
    f"SELECT p_partkey, replace({_TITLE_SQL.format('raw')}, ' District', '') AS district "
    "FROM (SELECT p_partkey, p_name || ' o''neil y.s.r. district' AS raw FROM part)",
)
def _(t):
    raw = F.concat("p_name", F.lit(" o'neil y.s.r. district"))
    return t.base("part").select("p_partkey", clean_district(raw).alias("district"))


@query(
    "scl04_clean_state_label",
    f"SELECT p_partkey, replace(replace({_TITLE_SQL.format('raw')}, '-', ' '), '&', 'and') AS state "
    "FROM (SELECT p_partkey, replace(p_name, ' ', '-&-') || '-isles' AS raw FROM part)",
)
def _(t):
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("-&-")), F.lit("-isles"))
    return t.base("part").select("p_partkey", clean_state_label(raw).alias("state"))


@query(
    "scl05_title_case",
    f"SELECT doc_id, {_TITLE_SQL.format('text')} AS title FROM documents",
)
def _(t):
    return t.base("documents").select("doc_id", title_case(F.col("text")).alias("title"))


@query(
    "scl06_quarter_tag",
    "SELECT o_orderkey, 'Q' || quarter(o_orderdate) AS quarter FROM orders",
)
def _(t):
    file_name = F.concat(F.quarter("o_orderdate"), F.lit(".json"))
    return t.base("orders").select("o_orderkey", quarter_tag(file_name).alias("quarter"))


@query(
    "scl07_with_log",
    over("agg_transaction", """SELECT state, year, quarter, transaction_type, transaction_count,
    round(ln(1 + transaction_count), 9) AS transaction_count_log FROM agg_transaction"""),
)
def _(t):
    logged = with_log(t.agg_transaction.drop("transaction_amount"), "transaction_count")
    return logged.withColumn("transaction_count_log", F.round("transaction_count_log", 9))


@query(
    "scl08_rescale",
    over(
        "top_transaction_pincode",
        """SELECT state, year, quarter, pincode, round(CASE WHEN hi = lo THEN 50.0
        ELSE (45.0::DOUBLE / (hi - lo)) * (transaction_amount - lo) + 5 END, 6) AS marker_size
        FROM top_transaction_pincode, (SELECT min(transaction_amount) AS lo, max(transaction_amount) AS hi FROM top_transaction_pincode)""",
    ),
)
def _(t):
    sized = rescale(t.top_transaction_pincode, "transaction_amount", "marker_size")
    return sized.select("state", "year", "quarter", "pincode", F.round("marker_size", 6).alias("marker_size"))


@query(
    "scl09_safe_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_extendedprice / nullif(l_discount, 0) AS ratio
    FROM lineitem""",
)
def _(t):
    return t.base("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        safe_ratio(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio"),
    )


@query(
    "scl10_round2",
    "SELECT o_orderkey, round(o_totalprice / 7, 2) AS rounded FROM orders",
)
def _(t):
    return t.base("orders").select("o_orderkey", round2(F.col("o_totalprice") / 7).alias("rounded"))


@query(
    "scl11_segment",
    """SELECT c_custkey, CASE WHEN g > 20 AND v > 100000 THEN 'Best' WHEN g <= 20 AND v > 100000 THEN 'Saturated'
    WHEN g > 20 AND v < 100000 THEN 'Rising' ELSE 'Idle' END AS category
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 41 END AS g,
                 CAST(c_acctbal * 20 AS BIGINT) // 50000 * 50000 AS v FROM customer)""",
)
def _(t):
    growth = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 41)
    volume = F.floor(F.rint(F.col("c_acctbal") * 20) / 50000) * 50000
    return t.base("customer").select("c_custkey", segment(growth, volume).alias("category"))


@query(
    "scl12_pct_change",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_tax = 0 AND l_discount = 0 THEN NULL
    WHEN l_tax = 0 THEN 'Infinity'::DOUBLE ELSE round((l_discount - l_tax) / l_tax * 100, 6) END AS change FROM lineitem""",
)
def _(t):
    change = pct_change(F.col("l_discount"), F.col("l_tax"))
    finite = F.when(change < float("inf"), F.round(change, 6)).otherwise(change)
    return t.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", finite.alias("change"))


@query(
    "scl15_truncate_int",
    "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer",
)
def _(t):
    return t.base("customer").select("c_custkey", truncate_int(F.col("c_acctbal")).alias("whole"))


@query(
    "prj03_place_year_label",
    over("agg_transaction", "SELECT state || ' - ' || year AS label, count(*) AS n FROM agg_transaction GROUP BY ALL"),
)
def _(t):
    label = place_year_label(F.col("state"), F.col("year"))
    return t.agg_transaction.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "udf01_human_columns",
    over(
        "map_user",
        f"""SELECT year, quarter, user_count, {human_double_sql('user_count')} AS user_counts_f
        FROM (SELECT year, quarter, CAST(sum(registered_users) AS BIGINT) AS user_count FROM map_user GROUP BY ALL)""",
    ),
)
def _(t):
    trend = period_trend(t.map_user, {"registered_users": "user_count"})
    return with_text(trend, {"user_count": "user_counts_f"}, as_double=True)
