"""Profiles, sinks and full refreshes."""

import atexit
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.operators import check_schema, column_list, duplicate_count, null_counts, profile_info
from geotrends.plans import profile_tables
from geotrends.schemas import SCHEMAS
from geotrends.sinks import create_tables, drop_tables, normalize_columns, refresh, register_view, with_surrogate_id, write_csv, write_tree
from geotrends.sources import (
    EXTRACTORS,
    extract,
    literal_rows,
    read_boundaries,
    read_country_tree,
    read_csv,
    read_table,
    read_tree,
)
from workload.q_ingest import (
    _SOURCES,
    COUNTRY_STATE_SQL,
    DISTRICT_SQL,
    LOCATION_SQL,
    LOCATIONS,
    STATE_SQL,
    round_trip,
    table_documents,
)
from workload.registry import query
from workload.views import over


def scratch(t) -> str:
    """A fresh folder in the warehouse, beside the tables; deleted at the end of the program."""
    path = f"{t.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_files-{uuid.uuid4().hex}"
    _MADE.append((t.spark, path, None))
    return path


_MADE: list = []


@atexit.register
def _clean() -> None:
    """Drop what the queries of this program have written, if the session still runs."""
    for spark, path, db in _MADE:
        context = spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            continue
        if db:
            drop_tables(spark, db)
        else:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


_WITH_GAPS = """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment FROM customer"""


def _with_gaps(t) -> DataFrame:
    return t.base("customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
    )


@query(
    "dq01_profile_info",
    f"""WITH g AS ({_WITH_GAPS})
    SELECT 'c_custkey' AS "column", 'bigint' AS dtype, count(c_custkey) AS non_null, count(*) AS rows FROM g
    UNION ALL SELECT 'balance', 'double', count(balance), count(*) FROM g
    UNION ALL SELECT 'segment', 'string', count(segment), count(*) FROM g""",
)
def _(t):
    return profile_info(_with_gaps(t))


@query(
    "dq02_duplicate_count",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem))
    AS duplicates FROM lineitem""",
)
def _(t):
    return duplicate_count(t.base("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    "dq03_null_counts",
    f"""WITH g AS ({_WITH_GAPS})
    SELECT 'c_custkey' AS "column", count(*) - count(c_custkey) AS nulls FROM g
    UNION ALL SELECT 'balance', count(*) - count(balance) FROM g
    UNION ALL SELECT 'segment', count(*) - count(segment) FROM g""",
)
def _(t):
    return null_counts(_with_gaps(t))


_BASE = ["nation", "customer", "supplier", "part", "orders", "lineitem"]


@query(
    "dq04_column_list",
    f"""SELECT table_name AS "table", CAST(ordinal_position AS INTEGER) AS position, column_name AS "column"
    FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{n}'" for n in _BASE)})""",
)
def _(t):
    return column_list(t.spark, {n: t.base(n) for n in _BASE})


@query("dq05_checked_table", over("agg_transaction", "SELECT * FROM agg_transaction"))
def _(t):
    df = normalize_columns(t.agg_transaction.withColumnRenamed("transaction_type", "Transaction_Type"))
    check_schema(df, SCHEMAS["aggregated_transaction"])
    return df


# All 14 tables -> the view that has their rows.
_PROFILED = {table: source[0] for table, source in _SOURCES.items()} | {
    "state_level_location_metrics": "location",
    "india_level_location_metrics": "country_location",
}
_VIEWS = " ".join(dict.fromkeys(_PROFILED.values()))


def _some(table: str) -> str:
    return "quarter = 'Q4'" if "quarter" in SCHEMAS[table].names else "state < 'NATION_2'"


def _doubled(t, table: str) -> DataFrame:
    """A table of which some rows stand twice: those of the fourth quarter, or of some states."""
    rows = getattr(t, _PROFILED[table])
    return rows.unionByName(rows.filter(_some(table)))


_DOUBLED_SQL = {n: f"(SELECT * FROM {v} UNION ALL SELECT * FROM {v} WHERE {_some(n)})" for n, v in _PROFILED.items()}


@query(
    "dq06_table_duplicates",
    over(
        _VIEWS,
        " UNION ALL ".join(
            f"""SELECT '{n}' AS "table", (SELECT count(*) FROM {_DOUBLED_SQL[n]}) - (SELECT count(*) FROM (SELECT DISTINCT *
            FROM {_DOUBLED_SQL[n]})) AS duplicates"""
            for n in _PROFILED
        ),
    ),
)
def _(t):
    return profile_tables({n: _doubled(t, n) for n in _PROFILED})["duplicates"]


_WIDE_SQL = """(SELECT * FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL
SELECT * FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 2)"""


@query("dq02_wide_duplicates", f"SELECT (SELECT count(*) FROM {_WIDE_SQL}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_WIDE_SQL})) AS duplicates")
def _(t):
    """Lines with their orders, those of the second line twice: compared by digests first."""
    rows = t.base("lineitem").join(t.base("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return duplicate_count(rows.unionByName(rows.filter("l_linenumber = 2")))


_PROFILED_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}


@query(
    "dq02_table_profiles",
    over(
        _VIEWS,
        " UNION ALL ".join(
            f"""SELECT '{n}' AS "table", '{f.name}' AS "column", '{f.dataType.simpleString()}' AS dtype,
            count({f.name}) AS non_null, count(*) AS rows, count(*) - count({f.name}) AS nulls FROM {v}"""
            for n, v in _PROFILED.items()
            for f in SCHEMAS[n].fields
        ),
    ),
)
def _(t):
    return profile_tables({n: getattr(t, v) for n, v in _PROFILED.items()})["info"]


@query(
    "snk01_csv_round_trip",
    over(
        "agg_insurance",
        """SELECT * REPLACE (CASE quarter WHEN 'Q1' THEN 'a "' || type || '", b' WHEN 'Q2' THEN '  ' || type || ' '
        WHEN 'Q3' THEN type END AS type) FROM agg_insurance""",
    ),
)
def _(t):
    """Names with quotes, commas and blanks, and nulls, through files."""
    path = scratch(t)
    odd = (
        F.when(F.col("quarter") == "Q1", F.concat(F.lit('a "'), "type", F.lit('", b')))
        .when(F.col("quarter") == "Q2", F.concat(F.lit("  "), "type", F.lit(" ")))
        .when(F.col("quarter") == "Q3", F.col("type"))
    )
    write_csv(t.agg_insurance.withColumn("type", odd), path)
    return read_csv(t.spark, path, SCHEMAS["aggregated_insurance"])


def _refreshed(t, tables: dict[str, DataFrame]) -> str:
    db = f"geotrends_{uuid.uuid4().hex}"
    create_tables(t.spark, db)
    _MADE.append((t.spark, None, db))
    refresh(t.spark, db, tables)
    return db


@query("snk03_refresh_twice", over("map_user", "SELECT * FROM map_user"))
def _(t):
    db = _refreshed(t, {"map_user": t.map_user})
    refresh(t.spark, db, {"map_user": t.map_user})
    return read_table(t.spark, "map_user", db)


@query(
    "snk05_normalized_columns",
    over("agg_insurance", "SELECT state, year, quarter, type, insurance_count, insurance_amount FROM agg_insurance"),
)
def _(t):
    shuffled = t.agg_insurance.select(*[F.col(c).alias(c.title()) for c in reversed(t.agg_insurance.columns)])
    return normalize_columns(shuffled, "aggregated_insurance")


@query(
    "snk06_surrogate_id",
    over(
        "top_user_pincode",
        """SELECT row_number() OVER (ORDER BY state, year, quarter, pincode) AS id, * FROM top_user_pincode""",
    ),
)
def _(t):
    return with_surrogate_id(t.top_user_pincode, ["state", "year", "quarter", "pincode"])


@query("snk07_view", over("map_insurance", "SELECT state, CAST(sum(insurance_count) AS BIGINT) AS total_volume FROM map_insurance GROUP BY ALL"))
def _(t):
    register_view(t.map_insurance, "volume_source")
    return t.spark.sql("SELECT state, sum(insurance_count) AS total_volume FROM volume_source GROUP BY state")


@query("src05_table_scan", over("agg_transaction", "SELECT * FROM agg_transaction"))
def _(t):
    db = _refreshed(t, {"aggregated_transaction": t.agg_transaction})
    return read_table(t.spark, "aggregated_transaction", db)


@query(
    "src07_boundaries",
    """SELECT n_name AS name, '{"type":"Point","coordinates":[' || n_nationkey || ',' || n_regionkey || ']}' AS geometry_json
    FROM nation""",
)
def _(t):
    """One feature collection per region, written as files and read back."""
    point = F.struct(F.lit("Point").alias("type"), F.array("n_nationkey", "n_regionkey").alias("coordinates"))
    feature = F.struct(F.struct(F.col("n_name").alias("ST_NM")).alias("properties"), point.alias("geometry"))
    shapes = t.base("nation").groupBy("n_regionkey").agg(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")
    )
    path = scratch(t)
    shapes.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_boundaries(t.spark, path)


@query(
    "src08_literal_rows",
    over(
        "agg_transaction",
        """SELECT quarter, half, CAST(sum(transaction_count) AS BIGINT) AS count FROM agg_transaction
        JOIN (VALUES ('Q1', 1), ('Q2', 1), ('Q3', 2), ('Q4', 2)) h(q, half) ON quarter = q GROUP BY ALL""",
    ),
)
def _(t):
    halves = literal_rows(t.spark, [("Q1", 1), ("Q2", 1), ("Q3", 2), ("Q4", 2)], "quarter STRING, half INT")
    joined = t.agg_transaction.join(halves, "quarter")
    return joined.groupBy("quarter", "half").agg(F.sum("transaction_count").alias("count"))


# Each table's measure.
_MEASURES = {
    "aggregated_user": "user_count",
    "aggregated_transaction": "transaction_count",
    "aggregated_insurance": "insurance_count",
    "map_user": "registered_users",
    "map_transaction": "transaction_count",
    "map_insurance": "insurance_count",
    "top_user_districtwise": "registered_users",
    "top_user_pincodewise": "registered_users",
    "top_transaction_districtwise": "transaction_count",
    "top_transaction_pincodewise": "transaction_count",
    "top_insurance_districtwise": "insurance_count",
    "top_insurance_pincodewise": "insurance_count",
    "state_level_location_metrics": "metric",
    "india_level_location_metrics": "metric",
}


def _loaded_sql(table: str) -> str:
    total = f"count(*) AS rows, CAST(sum({_MEASURES[table]}) AS BIGINT) AS total"
    if table in LOCATIONS:
        state = COUNTRY_STATE_SQL if EXTRACTORS[table].country else STATE_SQL
        return f"""SELECT '{table}' AS "table", {state} AS state, CAST(NULL AS INTEGER) AS year, {total} FROM {LOCATION_SQL} GROUP BY ALL"""
    return f"""SELECT '{table}' AS "table", {STATE_SQL} AS state, year, {total} FROM {_SOURCES[table][0]} GROUP BY ALL"""


@query(
    "ana13_refresh",
    over(
        " ".join(dict.fromkeys(["order_places", *(source[0] for source in _SOURCES.values())])),
        " UNION ALL ".join(map(_loaded_sql, _MEASURES)),
    ),
)
def _(t):
    """Documents into all 14 tables, twice; the second load replaces the first."""
    frames = {table: round_trip(t, table) for table in _MEASURES}
    db = _refreshed(t, frames)
    refresh(t.spark, db, frames)
    result = None
    for table, measure in _MEASURES.items():
        rows = read_table(t.spark, table, db)
        year = F.col("year") if "year" in rows.columns else F.lit(None).cast("int")
        totals = rows.groupBy("state", year.alias("year")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(measure).cast("bigint").alias("total")
        )
        totals = totals.select(F.lit(table).alias("table"), "*")
        result = totals if result is None else result.unionByName(totals)
    return result


def _tree(t, table: str) -> str:
    """The documents of a table as a tree of files, written by tasks into a shared folder; its root."""
    root = scratch(t)
    write_tree(table_documents(t, table).withColumn("path", F.substring_index("file_path", "file:/data/", -1)), root)
    return root


@query(
    "src01_tree_files",
    over("agg_transaction", f"SELECT {STATE_SQL} AS state, year, quarter, transaction_type, transaction_count, transaction_amount FROM agg_transaction"),
)
def _(t):
    root = _tree(t, "aggregated_transaction")
    return extract(read_tree(t.spark, root, "aggregated_transaction"), "aggregated_transaction")


@query(
    "src01_tree_files_of_a_year",
    over("map_user", f"SELECT {STATE_SQL} AS state, year, quarter, {DISTRICT_SQL} AS district, registered_users, appopen_count FROM map_user WHERE year = 1996"),
)
def _(t):
    """A glob for the year opens fewer files."""
    return extract(read_tree(t.spark, _tree(t, "map_user"), "map_user", year="1996"), "map_user")


@query(
    "src03_country_files",
    over("order_places", f"SELECT {COUNTRY_STATE_SQL} AS state, latitude, longitude, metric FROM {LOCATION_SQL}"),
)
def _(t):
    table = "india_level_location_metrics"
    return extract(read_country_tree(t.spark, _tree(t, table), "location"), table)
