"""Schemas of the flat tables and of the raw documents.

Counts are 64-bit and amounts are doubles in every table, so that tables with
the same measure also share its type.
"""

from pyspark.sql import types as T

_TEXT, _YEAR, _COUNT, _AMOUNT = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _table(**fields: T.DataType) -> T.StructType:
    """A table with the state and the period in front."""
    return _struct(state=_TEXT, year=_YEAR, quarter=_TEXT, **fields)


_USERS = {"registered_users": _COUNT}
_TRANSACTIONS = {"transaction_count": _COUNT, "transaction_amount": _AMOUNT}
_INSURANCE = {"insurance_count": _COUNT, "insurance_amount": _AMOUNT}
_COORDINATES = {"latitude": _AMOUNT, "longitude": _AMOUNT, "metric": _AMOUNT}

SCHEMAS: dict[str, T.StructType] = {
    "aggregated_user": _table(brand=_TEXT, user_count=_COUNT, user_percentage=_AMOUNT),
    "aggregated_transaction": _table(transaction_type=_TEXT, **_TRANSACTIONS),
    "aggregated_insurance": _table(type=_TEXT, **_INSURANCE),
    "map_user": _table(district=_TEXT, **_USERS, appopen_count=_COUNT),
    "map_transaction": _table(district=_TEXT, **_TRANSACTIONS),
    "map_insurance": _table(district=_TEXT, **_INSURANCE),
    "top_user_districtwise": _table(district=_TEXT, **_USERS),
    "top_user_pincodewise": _table(pincode=_TEXT, **_USERS),
    "top_transaction_districtwise": _table(district=_TEXT, **_TRANSACTIONS),
    "top_transaction_pincodewise": _table(pincode=_TEXT, **_TRANSACTIONS),
    "top_insurance_districtwise": _table(district=_TEXT, **_INSURANCE),
    "top_insurance_pincodewise": _table(pincode=_TEXT, **_INSURANCE),
    "state_level_location_metrics": _struct(state=_TEXT, district=_TEXT, **_COORDINATES),
    "india_level_location_metrics": _struct(state=_TEXT, **_COORDINATES),
}

# Element types inside the raw documents.
_MEASURE = _struct(count=_COUNT, amount=_AMOUNT)
_BRAND = _struct(brand=_TEXT, count=_COUNT, percentage=_AMOUNT)
_INSTRUMENT = _struct(name=_TEXT, paymentInstruments=T.ArrayType(_MEASURE))
_HOVER_USER = _struct(registeredUsers=_COUNT, appOpens=_COUNT)
_HOVER_METRIC = _struct(name=_TEXT, metric=T.ArrayType(_MEASURE))
_NAMED_USERS = _struct(name=_TEXT, registeredUsers=_COUNT)
_ENTITY_METRIC = _struct(entityName=_TEXT, metric=_MEASURE)
_TUPLE = T.ArrayType(_TEXT)

# Raw document set -> the nodes read from it: path -> (element type, is it a keyed object?).
DOCUMENT_NODES: dict[str, dict[str, tuple[T.DataType, bool]]] = {
    "aggregated_user": {"usersByDevice": (_BRAND, False)},
    "aggregated_transaction": {"transactionData": (_INSTRUMENT, False)},
    "aggregated_insurance": {"transactionData": (_INSTRUMENT, False)},
    "map_user": {"hoverData": (_HOVER_USER, True)},
    "map_transaction": {"hoverDataList": (_HOVER_METRIC, False)},
    "map_insurance": {"hoverDataList": (_HOVER_METRIC, False)},
    "top_user": {"districts": (_NAMED_USERS, False), "pincodes": (_NAMED_USERS, False)},
    "top_transaction": {"districts": (_ENTITY_METRIC, False), "pincodes": (_ENTITY_METRIC, False)},
    "top_insurance": {"districts": (_ENTITY_METRIC, False), "pincodes": (_ENTITY_METRIC, False)},
    "location": {"data.data": (_TUPLE, False)},
}


def node_schema(path: str, element: T.DataType, keyed: bool) -> T.StructType:
    """Schema of a document that holds ``element`` items at one node."""
    kind: T.DataType = T.MapType(_TEXT, element) if keyed else T.ArrayType(element)
    for name in reversed(path.split(".")):
        kind = _struct(**{name: kind})
    return _struct(data=kind)


def document_schema(entity: str) -> T.StructType:
    """Schema of the part of an ``entity`` document that is read."""
    fields = []
    for path, (element, keyed) in DOCUMENT_NODES[entity].items():
        fields += node_schema(path, element, keyed)["data"].dataType.fields
    return _struct(data=T.StructType(fields))
