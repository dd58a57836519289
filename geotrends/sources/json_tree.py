"""Trees of JSON documents whose keys are in the path.

One document per (entity, state, year, quarter):
``<root>/<entity path>/state/<state>/<year>/<quarter>.json``, and one per
(entity, year, quarter) at country level. The reader is schema-driven, so it
lists the files once and never scans them to infer types.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotrends.fixed_values import DOCUMENT_PATHS
from geotrends.functions.text import quarter_tag
from geotrends.schemas import DOCUMENT_NODES, document_schema

CORRUPT = "_corrupt_record"
PATH = "file_path"

_STATE_KEYS = r"/state/([^/]+)/(\d{4})/([^/]+)\.json$"
_COUNTRY_KEYS = r"/(\d{4})/([^/]+)\.json$"


def _decoded(path: Column) -> Column:
    # A plus sign is legal in a path but would decode to a space.
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def with_path_keys(df: DataFrame, path: str = PATH) -> DataFrame:
    """Add ``state, year, quarter`` taken from the file path; the state is the raw directory name.

    All three are null for a path of another form.
    """
    where = _decoded(F.col(path))
    return df.withColumns(
        {
            "state": _part(where, _STATE_KEYS, 1),
            "year": _part(where, _STATE_KEYS, 2).try_cast("int"),
            "quarter": quarter_tag(_part(where, _STATE_KEYS, 3)),
        }
    )


def _part(where: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(where, pattern, group), F.lit(""))


def with_country_path_keys(df: DataFrame, path: str = PATH) -> DataFrame:
    """Add ``year, quarter`` taken from the path of a country-level file; null for a path of another form."""
    where = _decoded(F.col(path))
    return df.withColumns(
        {
            "year": _part(where, _COUNTRY_KEYS, 1).try_cast("int"),
            "quarter": quarter_tag(_part(where, _COUNTRY_KEYS, 2)),
        }
    )


def unparsable() -> Column:
    # A wrong-typed field also fills the corrupt column, but leaves the rest of the data
    # or at least parses; broken JSON does neither.
    return F.col("data").isNull() & F.col(CORRUPT).isNotNull() & F.try_parse_json(F.col(CORRUPT)).isNull()


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable documents, unparsable documents as ``file_path, document``)."""
    good = df.filter(~unparsable())
    rejects = df.filter(unparsable()).select(PATH, F.col(CORRUPT).alias("document"))
    return good, rejects


def _strict(df: DataFrame) -> DataFrame:
    """Fail the job on the first unparsable document that a task meets."""
    message = F.concat(F.lit("unparsable document: "), F.col(PATH))
    return df.filter(F.when(unparsable(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def _read(spark: SparkSession, pattern: str, schema: T.StructType, strict: bool) -> DataFrame:
    raw = (
        spark.read.schema(_with_corrupt(schema))
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(pattern)
        .select("*", F.col("_metadata.file_path").alias(PATH))
    )
    return _strict(raw) if strict else raw


def read_tree(
    spark: SparkSession,
    root: str,
    entity: str,
    schema: T.StructType | None = None,
    strict: bool = True,
    state: str = "*",
    year: str = "*",
) -> DataFrame:
    """State-level documents of one entity with their path keys.

    ``state`` and ``year`` are glob parts: a narrower one lists and opens fewer
    files. ``strict`` fails on unparsable JSON; otherwise use
    :func:`split_rejects`.
    """
    pattern = f"{root}/{DOCUMENT_PATHS[entity]}/state/{state}/{year}/*.json"
    return with_path_keys(_read(spark, pattern, schema or document_schema(entity), strict))


def read_country_tree(
    spark: SparkSession,
    root: str,
    entity: str,
    schema: T.StructType | None = None,
    strict: bool = True,
    year: str = "[0-9]*",
) -> DataFrame:
    """Country-level documents; the glob leaves the ``state`` directory out."""
    pattern = f"{root}/{DOCUMENT_PATHS[entity]}/{year}/*.json"
    return with_country_path_keys(_read(spark, pattern, schema or document_schema(entity), strict))


def parse_documents(df: DataFrame, entity: str, text: str = "document", path: str = PATH) -> DataFrame:
    """The same frame as :func:`read_tree`, from documents held in a text column."""
    if entity not in DOCUMENT_NODES:
        raise KeyError(entity)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(F.col(text), _with_corrupt(document_schema(entity)), options)
    return df.select(F.col(path).alias(PATH), parsed.alias("_doc")).select("_doc.*", PATH)
