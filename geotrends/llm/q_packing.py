"""Query of packing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrends.llm.packing import pack
from geotrends.llm.registry import query, table


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    """Path of a public tokenizer's file; it is read where it lies."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{folder}/{name}"
    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """Digest columns of the packed pieces."""
    return pack(docs, tokenizer_path()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packed(table(spark, sf_dir, "documents"))
