"""Documents built from the given tables and flattened again by the extractors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotrends.fixed_values import DOCUMENT_PATHS
from geotrends.sources import (
    EXTRACTORS,
    extract,
    parse_documents,
    rejected_documents,
    rejected_elements,
    split_rejects,
    with_country_path_keys,
    with_path_keys,
)
from workload.registry import query
from workload.views import over

# Directory names as they are before cleaning, and the clean names.
_SPECIAL = {
    "NATION_0": ("andaman-&-nicobar-islands", "Andaman & Nicobar"),
    "NATION_1": ("jammu-&-kashmir", "Jammu & Kashmir"),
    "NATION_2": ("dadra-&-nagar-haveli", "Dadra and Nagar Haveli and Daman and Diu"),
}
STATE_SQL = (
    "CASE state " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _SPECIAL.items()) + " ELSE replace(state, 'NATION_', 'Nation ') END"
)
DISTRICT_SQL = "upper(district[1]) || lower(district[2:])"


def _directory() -> Column:
    name = F.replace(F.lower("state"), F.lit("_"), F.lit("-"))
    for state, (directory, _) in _SPECIAL.items():
        name = F.when(F.col("state") == state, F.lit(directory)).otherwise(name)
    return name


def _raw_district() -> Column:
    return F.concat(F.lower("district"), F.lit(" district"))


def _path(entity: str, country: bool = False, chunk: Column | None = None) -> Column:
    """URL-encoded path as the file scan reports it."""
    directory = [] if country else [F.lit("/state/"), _directory()]
    part = [] if chunk is None else [F.lit("-"), chunk.cast("string")]
    return F.concat(
        F.lit(f"file:/data/{DOCUMENT_PATHS[entity]}"),
        *directory,
        F.lit("/"),
        F.col("year").cast("string"),
        F.lit("/"),
        F.substring("quarter", 2, 1),
        *part,
        F.lit(".json"),
    )


def _measure(kind: str) -> Column:
    return F.struct(F.col(f"{kind}_count").alias("count"), F.col(f"{kind}_amount").alias("amount"))


def _element(table: str) -> Column:
    """The document element of one flat row."""
    kind = "insurance" if "insurance" in table else "transaction"
    if table == "aggregated_user":
        return F.struct("brand", F.col("user_count").alias("count"), F.col("user_percentage").alias("percentage"))
    if table.startswith("aggregated"):
        name = F.col("transaction_type" if kind == "transaction" else "type").alias("name")
        return F.struct(name, F.array(_measure(kind)).alias("paymentInstruments"))
    if table == "map_user":
        users = F.struct(F.col("registered_users").alias("registeredUsers"), F.col("appopen_count").alias("appOpens"))
        return F.struct(_raw_district().alias("key"), users.alias("value"))
    if table.startswith("map"):
        return F.struct(_raw_district().alias("name"), F.array(_measure(kind)).alias("metric"))
    place = F.col("pincode") if table.endswith("pincodewise") else _raw_district()
    if table.startswith("top_user"):
        return F.struct(place.alias("name"), F.col("registered_users").alias("registeredUsers"))
    return F.struct(place.alias("entityName"), _measure(kind).alias("metric"))


def _nested(node: str, items: Column) -> Column:
    for part in reversed(node.split(".")):
        items = F.struct(items.alias(part))
    return F.to_json(F.struct(items.alias("data")))


def documents(df: DataFrame, table: str, element: Column | None = None) -> DataFrame:
    """One document per state and quarter: ``file_path, document``.

    Places with many members are spread over several documents of at most 64
    elements, as a quarter may have several files.
    """
    x = EXTRACTORS[table]
    chunk = F.floor(F.col("pincode").cast("bigint") / 64) if "pincode" in df.columns else None
    path = _path(x.entity, x.country, chunk)
    items = F.collect_list("element")
    if table == "map_user":
        items = F.map_from_entries(items)
    rows = df.select(path.alias("file_path"), (element if element is not None else _element(table)).alias("element"))
    return rows.groupBy("file_path").agg(_nested(x.node, items).alias("document"))


_SOURCES = {
    "aggregated_user": ("agg_user", "brand, user_count, user_percentage"),
    "aggregated_transaction": ("agg_transaction", "transaction_type, transaction_count, transaction_amount"),
    "aggregated_insurance": ("agg_insurance", "type, insurance_count, insurance_amount"),
    "map_user": ("map_user", f"{DISTRICT_SQL} AS district, registered_users, appopen_count"),
    "map_transaction": ("map_transaction", f"{DISTRICT_SQL} AS district, transaction_count, transaction_amount"),
    "map_insurance": ("map_insurance", f"{DISTRICT_SQL} AS district, insurance_count, insurance_amount"),
    "top_user_districtwise": ("top_user_district", f"{DISTRICT_SQL} AS district, registered_users"),
    "top_user_pincodewise": ("top_user_pincode", "pincode, registered_users"),
    "top_transaction_districtwise": (
        "map_transaction",
        f"{DISTRICT_SQL} AS district, transaction_count, transaction_amount",
    ),
    "top_transaction_pincodewise": ("top_transaction_pincode", "pincode, transaction_count, transaction_amount"),
    "top_insurance_districtwise": ("map_insurance", f"{DISTRICT_SQL} AS district, insurance_count, insurance_amount"),
    "top_insurance_pincodewise": ("top_insurance_pincode", "pincode, insurance_count, insurance_amount"),
}


LOCATIONS = ("state_level_location_metrics", "india_level_location_metrics")


def table_documents(t, table: str) -> DataFrame:
    """The documents of any of the 14 tables."""
    if table not in LOCATIONS:
        return documents(getattr(t, _SOURCES[table][0]), table)
    label = _raw_district()
    if EXTRACTORS[table].country:
        label = F.concat(F.replace(F.lower("state"), F.lit("_"), F.lit("-")), F.lit("-&-isles"))
    return documents(_location_rows(t), table, _tuple(label))


def round_trip(t, table: str) -> DataFrame:
    """Flat rows to documents and back."""
    x = EXTRACTORS[table]
    keyed = with_country_path_keys if x.country else with_path_keys
    return extract(keyed(parse_documents(table_documents(t, table), x.entity)), table)


for _number, (_table, (_view, _columns)) in enumerate(_SOURCES.items(), start=1):

    @query(
        f"ext{_number:02d}_{_table}",
        over(_view, f"SELECT {STATE_SQL} AS state, year, quarter, {_columns} FROM {_view}"),
    )
    def _(t, table=_table):
        return round_trip(t, table)


def _location_rows(t) -> DataFrame:
    """The order places with coordinates per quarter, keys kept."""
    counts = t.order_places.groupBy("state", "n_nationkey", "year", "quarter", "district").agg(
        F.count(F.lit(1)).alias("metric")
    )
    return counts.withColumns(
        {
            "latitude": F.col("n_nationkey") + F.length("district") / 16.0,
            "longitude": 68 + F.length("district") / 4.0,
        }
    )


LOCATION_SQL = """(SELECT state, district, n_nationkey + length(district) / 16.0::DOUBLE AS latitude,
68 + length(district) / 4.0::DOUBLE AS longitude, CAST(count(*) AS DOUBLE) AS metric
FROM order_places GROUP BY state, n_nationkey, year, quarter, district)"""


def _tuple(label: Column) -> Column:
    return F.array(*[F.col(c).cast("string") for c in ("latitude", "longitude", "metric")], label)


@query(
    "ext13_state_location",
    over(
        "order_places",
        f"SELECT {STATE_SQL} AS state, {DISTRICT_SQL} AS district, latitude, longitude, metric FROM {LOCATION_SQL}",
    ),
)
def _(t):
    return round_trip(t, "state_level_location_metrics")


COUNTRY_STATE_SQL = "replace(state, 'NATION_', 'Nation ') || ' and Isles'"


@query(
    "ext14_country_location",
    over(
        "order_places",
        f"SELECT {COUNTRY_STATE_SQL} AS state, latitude, longitude, metric FROM {LOCATION_SQL}",
    ),
)
def _(t):
    return round_trip(t, "india_level_location_metrics")


@query(
    "src02_path_keys",
    over(
        "agg_transaction",
        """SELECT CASE state WHEN 'NATION_0' THEN 'andaman-&-nicobar-islands' WHEN 'NATION_1' THEN 'jammu-&-kashmir'
        WHEN 'NATION_2' THEN 'dadra-&-nagar-haveli' ELSE replace(lower(state), '_', '-') END AS state, year, quarter
        FROM agg_transaction""",
    ),
)
def _(t):
    paths = t.agg_transaction.select(_path("aggregated_transaction").alias("file_path"))
    return with_path_keys(paths).select("state", "year", "quarter")


@query(
    "src03_country_path_keys",
    over("agg_transaction", "SELECT DISTINCT year, quarter FROM agg_transaction"),
)
def _(t):
    paths = t.agg_transaction.select(_path("location", country=True).alias("file_path")).distinct()
    return with_country_path_keys(paths).select("year", "quarter")


def _some_broken(t) -> DataFrame:
    """Documents of which those of the year 2000 end too early."""
    docs = documents(t.agg_user, "aggregated_user")
    broken = F.col("file_path").contains("/2000/")
    cut = F.substring("document", F.lit(1), F.length("document") - 3)
    return docs.withColumn("document", F.when(broken, cut).otherwise(F.col("document")))


@query(
    "src04_unparsable_documents",
    over("agg_user", "SELECT state, quarter, count(*) AS n FROM (SELECT DISTINCT state, quarter FROM agg_user WHERE year = 2000) GROUP BY ALL"),
)
def _(t):
    _, rejects = split_rejects(parse_documents(_some_broken(t), "aggregated_user"))
    keyed = with_path_keys(rejects)
    names = {directory: state for state, (directory, _) in _SPECIAL.items()}
    state = F.upper(F.replace("state", F.lit("-"), F.lit("_")))
    for directory, name in names.items():
        state = F.when(F.col("state") == directory, F.lit(name)).otherwise(state)
    return keyed.groupBy(state.alias("state"), "quarter").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src04_readable_documents",
    over(
        "agg_user",
        f"SELECT {STATE_SQL} AS state, year, quarter, brand, user_count, user_percentage FROM agg_user WHERE year <> 2000",
    ),
)
def _(t):
    good, _ = split_rejects(parse_documents(_some_broken(t), "aggregated_user"))
    return extract(with_path_keys(good), "aggregated_user")


def _some_damaged(t) -> DataFrame:
    """Documents in which elements with a count of 3 hold text instead, and those with 4 miss it."""
    count = F.when(F.col("user_count") == 3, F.lit("three")).when(
        F.col("user_count") != 4, F.col("user_count").cast("string")
    )
    element = F.struct("brand", count.alias("count"), F.col("user_percentage").alias("percentage"))
    docs = documents(t.agg_user, "aggregated_user", element)
    # Counts are numbers in a document: take the quotes of the digits away.
    return docs.withColumn("document", F.regexp_replace("document", r'"count":"(\d+)"', '"count":$1'))


@query(
    "src04_kept_elements",
    over(
        "agg_user",
        f"""SELECT {STATE_SQL} AS state, year, quarter, brand, user_count, user_percentage FROM agg_user
        WHERE user_count NOT IN (3, 4)""",
    ),
)
def _(t):
    raw = with_path_keys(parse_documents(_some_damaged(t), "aggregated_user"))
    return extract(raw, "aggregated_user")


@query(
    "src04_rejected_elements",
    over(
        "agg_user",
        "SELECT year, quarter, brand, count(*) AS n FROM agg_user WHERE user_count IN (3, 4) GROUP BY ALL",
    ),
)
def _(t):
    raw = with_path_keys(parse_documents(_some_damaged(t), "aggregated_user"))
    rejects = with_path_keys(rejected_elements(raw, "aggregated_user"))
    brand = F.get_json_object("element", "$.brand").alias("brand")
    return rejects.groupBy("year", "quarter", brand).agg(F.count(F.lit(1)).alias("n"))


def _some_unusable(t) -> DataFrame:
    """Documents whose node is missing (Q1), null (Q2) or text (Q3), and of 1997 some in another folder."""
    docs = documents(t.agg_user, "aggregated_user")
    quarter = F.regexp_extract("file_path", r"/(\d)\.json$", 1)
    node = (
        F.when(quarter == "1", F.lit('{"data":{}}'))
        .when(quarter == "2", F.lit('{"data":{"usersByDevice":null}}'))
        .when(quarter == "3", F.lit('{"data":{"usersByDevice":"odd"}}'))
        .otherwise(F.col("document"))
    )
    moved = F.replace("file_path", F.lit("/state/"), F.lit("/place/"))
    path = F.when(F.col("file_path").contains("/1997/4"), moved).otherwise(F.col("file_path"))
    return docs.select(path.alias("file_path"), node.alias("document"))


@query(
    "src04_rejected_documents",
    over(
        "agg_user",
        """SELECT reason, year, quarter, count(*) AS n FROM (
          SELECT DISTINCT state, CASE WHEN quarter = 'Q4' THEN 'no keys' ELSE 'no node' END AS reason,
            CASE WHEN quarter <> 'Q4' THEN year END AS year, CASE WHEN quarter <> 'Q4' THEN quarter END AS quarter
          FROM agg_user WHERE quarter <> 'Q4' OR year = 1997) GROUP BY ALL""",
    ),
)
def _(t):
    raw = with_path_keys(parse_documents(_some_unusable(t), "aggregated_user"))
    rejects = with_path_keys(rejected_documents(raw, "aggregated_user"))
    return rejects.groupBy("reason", "year", "quarter").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src04_usable_documents",
    over(
        "agg_user",
        f"""SELECT {STATE_SQL} AS state, year, quarter, brand, user_count, user_percentage FROM agg_user
        WHERE quarter = 'Q4' AND year <> 1997""",
    ),
)
def _(t):
    return extract(with_path_keys(parse_documents(_some_unusable(t), "aggregated_user")), "aggregated_user")
