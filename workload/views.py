"""The flat tables of the library, derived from the given star-schema tables.

Each view exists twice: as a DataFrame (``Tables``) and as the SQL text of a
CTE (``VIEW_SQL``). Both read their base tables whole.
"""

from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geotrends.functions.numbers import money_sum


def _period(c: str) -> list:
    return [F.year(c).alias("year"), F.concat(F.lit("Q"), F.quarter(c)).alias("quarter")]


# Scans of the given tables by session and path. The tables do not change, so
# their footers are read for the schema once and not once per query.
_SCANS: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()


class Tables:
    """Base tables and derived views of one scale factor, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir

    def base(self, name: str) -> DataFrame:
        scans = _SCANS.setdefault(self.spark, {})
        path = f"{self._dir}/{name}.parquet"
        if path not in scans:
            scans[path] = self.spark.read.parquet(path)
        return scans[path]

    @cached_property
    def customer_places(self) -> DataFrame:
        nation = self.base("nation").select("n_nationkey", F.col("n_name").alias("state"))
        customer = self.base("customer")
        return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
            "c_custkey", "c_acctbal", "state", "n_nationkey", F.col("c_mktsegment").alias("district")
        )

    @cached_property
    def order_places(self) -> DataFrame:
        orders = self.base("orders")
        places = self.customer_places
        return orders.join(places, orders.o_custkey == places.c_custkey).select(
            "state",
            *_period("o_orderdate"),
            "n_nationkey",
            "district",
            "c_custkey",
            F.col("c_custkey").cast("string").alias("pincode"),
            F.col("o_orderpriority").alias("transaction_type"),
            "o_totalprice",
        )

    @cached_property
    def line_places(self) -> DataFrame:
        lines = self.base("lineitem")
        part = self.base("part").select("p_partkey", "p_brand", "p_type")
        nation = self.base("nation").select("n_nationkey", F.col("n_name").alias("state"))
        supplier = self.base("supplier")
        places = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("s_suppkey", "state")
        return (
            lines.join(part, lines.l_partkey == part.p_partkey)
            .join(places, lines.l_suppkey == places.s_suppkey)
            .select(
                "state",
                *_period("l_shipdate"),
                F.col("p_brand").alias("brand"),
                F.col("p_type").alias("type"),
                "l_extendedprice",
            )
        )

    def _transactions(self, key: str) -> DataFrame:
        return self.order_places.groupBy("state", "year", "quarter", key).agg(
            F.count(F.lit(1)).alias("transaction_count"), money_sum(F.col("o_totalprice")).alias("transaction_amount")
        )

    @cached_property
    def agg_transaction(self) -> DataFrame:
        return self._transactions("transaction_type")

    @cached_property
    def map_transaction(self) -> DataFrame:
        return self._transactions("district")

    @cached_property
    def top_transaction_pincode(self) -> DataFrame:
        return self._transactions("pincode")

    @cached_property
    def map_user(self) -> DataFrame:
        # Orders are counted per customer and quarter before the join. The distinct
        # count is then a plain count, and a customer with very many orders is one
        # row per quarter by the time rows meet on the customer key.
        each = self.base("orders").groupBy("o_custkey", *_period("o_orderdate")).agg(F.count(F.lit(1)).alias("n"))
        joined = each.join(self.customer_places, F.col("o_custkey") == F.col("c_custkey"))
        return joined.groupBy("state", "year", "quarter", "district").agg(
            F.count(F.lit(1)).alias("registered_users"), F.sum("n").alias("appopen_count")
        )

    @cached_property
    def top_user_district(self) -> DataFrame:
        return self.map_user.select("state", "year", "quarter", "district", "registered_users")

    @cached_property
    def top_user_pincode(self) -> DataFrame:
        return self.order_places.groupBy("state", "year", "quarter", "pincode").agg(
            F.count(F.lit(1)).alias("registered_users")
        )

    @cached_property
    def agg_user(self) -> DataFrame:
        period = ["state", "year", "quarter"]
        counts = self.line_places.groupBy(*period, "brand").agg(F.count(F.lit(1)).alias("user_count"))
        # The window holds one row per brand of a state and quarter.
        total = F.sum("user_count").over(Window.partitionBy(*period))
        return counts.withColumn("user_percentage", F.col("user_count") / total)

    def _insurance(self, name: str) -> DataFrame:
        return self.line_places.groupBy("state", "year", "quarter", F.col("type").alias(name)).agg(
            F.count(F.lit(1)).alias("insurance_count"), money_sum(F.col("l_extendedprice")).alias("insurance_amount")
        )

    @cached_property
    def agg_insurance(self) -> DataFrame:
        return self._insurance("type")

    @cached_property
    def map_insurance(self) -> DataFrame:
        return self._insurance("district")

    @cached_property
    def top_insurance_pincode(self) -> DataFrame:
        # Suppliers stand for pincodes here.
        lines, nation = self.base("lineitem"), self.base("nation").select("n_nationkey", F.col("n_name").alias("state"))
        supplier = self.base("supplier")
        places = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select("s_suppkey", "state")
        rows = lines.join(places, lines.l_suppkey == places.s_suppkey).select(
            "state", *_period("l_shipdate"), F.col("s_suppkey").cast("string").alias("pincode"), "l_extendedprice"
        )
        return rows.groupBy("state", "year", "quarter", "pincode").agg(
            F.count(F.lit(1)).alias("insurance_count"), money_sum(F.col("l_extendedprice")).alias("insurance_amount")
        )

    @cached_property
    def location(self) -> DataFrame:
        # One row per place and quarter, so that places repeat. The fractions
        # are 64ths, which every engine adds without rounding.
        rows = self.order_places.groupBy("state", "n_nationkey", "year", "quarter", "district").agg(
            F.count(F.lit(1)).cast("double").alias("metric")
        )
        years = F.col("year") - 1990
        return rows.select(
            "state",
            "district",
            ((F.col("n_nationkey") * 64 + F.length("district") * 4 + years) / 64.0).alias("latitude"),
            (68 + (F.length("district") * 64 + years * 2) / 64.0).alias("longitude"),
            "metric",
        )

    @cached_property
    def country_location(self) -> DataFrame:
        return self.location.select("state", "latitude", "longitude", "metric")

    @cached_property
    def years(self) -> DataFrame:
        return self.agg_transaction.select("year").distinct()


_ORDER_PLACES = """
SELECT n_name AS state, CAST(year(o_orderdate) AS INTEGER) AS year, 'Q' || quarter(o_orderdate) AS quarter,
       n_nationkey, c_mktsegment AS district, c_custkey, CAST(c_custkey AS VARCHAR) AS pincode,
       o_orderpriority AS transaction_type, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

_LINE_PLACES = """
SELECT n_name AS state, CAST(year(l_shipdate) AS INTEGER) AS year, 'Q' || quarter(l_shipdate) AS quarter,
       p_brand AS brand, p_type AS type, CAST(s_suppkey AS VARCHAR) AS pincode, l_extendedprice
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
"""


def money_sql(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def _transactions_sql(key: str) -> str:
    return f"""SELECT state, year, quarter, {key}, count(*) AS transaction_count,
    {money_sql('o_totalprice')} AS transaction_amount FROM order_places GROUP BY ALL"""


def _insurance_sql(source: str, name: str) -> str:
    return f"""SELECT state, year, quarter, {source} AS {name}, count(*) AS insurance_count,
    {money_sql('l_extendedprice')} AS insurance_amount FROM line_places GROUP BY ALL"""


# name -> (views it reads, SELECT text)
VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "order_places": ([], _ORDER_PLACES),
    "line_places": ([], _LINE_PLACES),
    "agg_transaction": (["order_places"], _transactions_sql("transaction_type")),
    "map_transaction": (["order_places"], _transactions_sql("district")),
    "top_transaction_pincode": (["order_places"], _transactions_sql("pincode")),
    "map_user": (
        ["order_places"],
        """SELECT state, year, quarter, district, count(DISTINCT c_custkey) AS registered_users,
        count(*) AS appopen_count FROM order_places GROUP BY ALL""",
    ),
    "top_user_district": (["map_user"], "SELECT state, year, quarter, district, registered_users FROM map_user"),
    "top_user_pincode": (
        ["order_places"],
        "SELECT state, year, quarter, pincode, count(*) AS registered_users FROM order_places GROUP BY ALL",
    ),
    "agg_user": (
        ["line_places"],
        """SELECT state, year, quarter, brand, user_count,
        user_count / sum(user_count) OVER (PARTITION BY state, year, quarter) AS user_percentage
        FROM (SELECT state, year, quarter, brand, count(*) AS user_count FROM line_places GROUP BY ALL)""",
    ),
    "agg_insurance": (["line_places"], _insurance_sql("type", "type")),
    "map_insurance": (["line_places"], _insurance_sql("type", "district")),
    "top_insurance_pincode": (["line_places"], _insurance_sql("pincode", "pincode")),
    "location": (
        ["order_places"],
        """SELECT state, district, (n_nationkey * 64 + length(district) * 4 + year - 1990) / 64.0::DOUBLE AS latitude,
        68 + (length(district) * 64 + (year - 1990) * 2) / 64.0::DOUBLE AS longitude, metric
        FROM (SELECT state, n_nationkey, year, quarter, district, CAST(count(*) AS DOUBLE) AS metric
              FROM order_places GROUP BY ALL)""",
    ),
    "country_location": (["location"], "SELECT state, latitude, longitude, metric FROM location"),
    "years": (["agg_transaction"], "SELECT DISTINCT year FROM agg_transaction"),
}


def over(views: str, body: str, **ctes: str) -> str:
    """``body`` preceded by the CTEs of ``views`` (space-separated) and by ``ctes``."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in parts:
            needs, text = VIEW_SQL[name]
            for other in needs:
                add(other)
            parts[name] = text

    for view in views.split():
        add(view)
    parts |= ctes
    if not parts:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts.items()) + "\n" + body


def human_sql(c: str) -> str:
    """Human-readable text of a number."""
    return f"""CASE WHEN {c} > 1e12 THEN printf('%.2f T', {c} / 1e12)
    WHEN {c} > 1e9 THEN printf('%.2f B', {c} / 1e9) WHEN {c} > 1e7 THEN printf('%.2f Cr', {c} / 1e7)
    WHEN {c} > 1e6 THEN printf('%.2f M', {c} / 1e6) WHEN {c} > 1e3 THEN printf('%.2f k', {c} / 1e3)
    ELSE CAST({c} AS VARCHAR) END"""


def human_double_sql(c: str) -> str:
    return human_sql(f"CAST({c} AS DOUBLE)")
