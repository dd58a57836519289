"""Nested documents to flat rows.

Every extractor is the same plan: explode one node, project the fields, clean
the names. There is no shuffle. A damaged element is rejected on its own and
its neighbours are kept; :func:`rejected_elements` lists what was left out.
Documents without a usable node or without keys in their path give no rows and are
listed by :func:`rejected_documents`, so what was read is kept or listed.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrends.functions.text import canonical_state, clean_district, clean_state_label
from geotrends.schemas import DOCUMENT_NODES, SCHEMAS, node_schema
from geotrends.sources.json_tree import CORRUPT, PATH, unparsable

# Element (and its key, in a keyed object) -> columns, names as they are in the document.
Fields = Callable[[Column, Column], dict[str, Column]]


@dataclass(frozen=True)
class Extractor:
    """Which node of which document set gives which columns of which table."""

    table: str
    entity: str
    node: str
    fields: Fields
    country: bool = False


def _brand(_: Column, e: Column) -> dict[str, Column]:
    return {"brand": e["brand"], "user_count": e["count"], "user_percentage": e["percentage"]}


def _payment(kind: str, measure: str) -> Fields:
    def fields(_: Column, e: Column) -> dict[str, Column]:
        first = F.get(e["paymentInstruments"], F.lit(0))
        return {kind: e["name"], f"{measure}_count": first["count"], f"{measure}_amount": first["amount"]}

    return fields


def _hover_users(key: Column, e: Column) -> dict[str, Column]:
    return {"district": key, "registered_users": e["registeredUsers"], "appopen_count": e["appOpens"]}


def _hover_metric(measure: str) -> Fields:
    def fields(_: Column, e: Column) -> dict[str, Column]:
        first = F.get(e["metric"], F.lit(0))
        return {"district": e["name"], f"{measure}_count": first["count"], f"{measure}_amount": first["amount"]}

    return fields


def _top_users(place: str) -> Fields:
    return lambda _, e: {place: e["name"], "registered_users": e["registeredUsers"]}


def _top_metric(place: str, measure: str) -> Fields:
    def fields(_: Column, e: Column) -> dict[str, Column]:
        metric = e["metric"]
        return {place: e["entityName"], f"{measure}_count": metric["count"], f"{measure}_amount": metric["amount"]}

    return fields


def _location(label: str) -> Fields:
    def fields(_: Column, e: Column) -> dict[str, Column]:
        latitude, longitude, metric, name = (F.when(F.size(e) == 4, F.get(e, F.lit(i))) for i in range(4))
        return {
            label: name,
            "latitude": latitude.try_cast("double"),
            "longitude": longitude.try_cast("double"),
            "metric": metric.try_cast("double"),
        }

    return fields


EXTRACTORS: dict[str, Extractor] = {
    x.table: x
    for x in [
        Extractor("aggregated_user", "aggregated_user", "usersByDevice", _brand),
        Extractor(
            "aggregated_transaction",
            "aggregated_transaction",
            "transactionData",
            _payment("transaction_type", "transaction"),
        ),
        Extractor("aggregated_insurance", "aggregated_insurance", "transactionData", _payment("type", "insurance")),
        Extractor("map_user", "map_user", "hoverData", _hover_users),
        Extractor("map_transaction", "map_transaction", "hoverDataList", _hover_metric("transaction")),
        Extractor("map_insurance", "map_insurance", "hoverDataList", _hover_metric("insurance")),
        Extractor("top_user_districtwise", "top_user", "districts", _top_users("district")),
        Extractor("top_user_pincodewise", "top_user", "pincodes", _top_users("pincode")),
        Extractor(
            "top_transaction_districtwise", "top_transaction", "districts", _top_metric("district", "transaction")
        ),
        Extractor("top_transaction_pincodewise", "top_transaction", "pincodes", _top_metric("pincode", "transaction")),
        Extractor("top_insurance_districtwise", "top_insurance", "districts", _top_metric("district", "insurance")),
        Extractor("top_insurance_pincodewise", "top_insurance", "pincodes", _top_metric("pincode", "insurance")),
        Extractor("state_level_location_metrics", "location", "data.data", _location("district")),
        Extractor("india_level_location_metrics", "location", "data.data", _location("state"), country=True),
    ]
}


def _node(x: Extractor) -> Column:
    """The node as a list of (key, value) or of values, however well it parsed.

    One item of a foreign type empties the whole list in the reader. Only then
    is the document text parsed again, item by item.
    """
    element, keyed = DOCUMENT_NODES[x.entity][x.node]
    parsed = F.col(f"data.{x.node}")
    again = F.from_json(F.col(CORRUPT), node_schema(x.node, T.StringType(), keyed))["data"]
    for part in x.node.split("."):
        again = again[part]

    def item(text: Column) -> Column:
        return F.from_json(text, element)

    if keyed:
        retried = F.transform_values(again, lambda _, v: item(v))
    else:
        retried = F.transform(again, item)
    return F.when(parsed.isNull() & F.col(CORRUPT).isNotNull(), retried).otherwise(parsed)


def _has_keys(x: Extractor) -> Column:
    keys = [] if x.country else ["state", "year", "quarter"]
    found = F.lit(True)
    for key in keys:
        found = found & F.col(key).isNotNull()
    return found


def _exploded(raw: DataFrame, x: Extractor) -> DataFrame:
    """One row per element: path keys, ``_position``, ``_element`` and ``_complete``.

    The state name is cleaned here, once per document. The check looks at the
    names as read, so that the filter on it stays cheap. A document without
    keys has no elements.
    """
    _, keyed = DOCUMENT_NODES[x.entity][x.node]
    explode = F.explode if keyed else F.posexplode
    keys = [F.col(PATH)]
    if not x.country:
        keys += [canonical_state(F.col("state")).alias("state"), F.col("year"), F.col("quarter")]
    # No filter on the keys: it would be moved below them and take them from the path again.
    documents = raw.select(*keys, F.when(_has_keys(x), _node(x)).alias("_node"))
    rows = documents.select(*[c for c in documents.columns if c != "_node"], explode("_node").alias("_position", "_element"))
    complete = F.lit(True)
    for c in x.fields(F.col("_position"), F.col("_element")).values():
        complete = complete & c.isNotNull()
    return rows.withColumn("_complete", complete)


def extract(raw: DataFrame, table: str) -> DataFrame:
    """Flat rows of ``table`` from its raw documents."""
    x = EXTRACTORS[table]
    fields = x.fields(F.col("_position"), F.col("_element"))
    if "district" in fields:
        fields["district"] = clean_district(fields["district"])
    if x.country:
        fields["state"] = clean_state_label(fields["state"])
    rows = _exploded(raw, x).filter("_complete")
    return rows.select(
        *[fields.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields]
    )


def rejected_documents(raw: DataFrame, table: str) -> DataFrame:
    """Documents that give :func:`extract` nothing to look at: ``file_path, reason``.

    ``unparsable``: not JSON. ``no keys``: the path does not name state, year
    and quarter. ``no node``: the node is missing, null or of a foreign type.
    A node without elements is no reject.
    """
    x = EXTRACTORS[table]
    reason = (
        F.when(unparsable(), F.lit("unparsable"))
        .when(~_has_keys(x), F.lit("no keys"))
        .when(_node(x).isNull(), F.lit("no node"))
    )
    return raw.select(PATH, reason.alias("reason")).filter(F.col("reason").isNotNull())


def rejected_elements(raw: DataFrame, table: str) -> DataFrame:
    """Elements that :func:`extract` leaves out: ``file_path, position, element``.

    The position is the index in the list, or the key in a keyed object.
    """
    rows = _exploded(raw, EXTRACTORS[table]).filter(~F.col("_complete"))
    return rows.select(
        PATH, F.col("_position").cast("string").alias("position"), F.to_json("_element").alias("element")
    )
