"""op1: all documents into shards 0 to 7."""

from pyspark.sql import functions as F

from gridlore.llm.common import cut, table
from gridlore.llm.sharding import shuffle_into_shards

NAME = "op1_shard_documents"
ORACLE_SQL = None  # the assignment is random by construction; tests hold it against the law and brute force
N_SHARDS = 8


def query(spark, sf_dir):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; a null text has size 1 and a null checksum."""
    docs = table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    # the text is read once; what the shuffle needs of it is small
    narrow = cut(docs.select("doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")))
    placed = shuffle_into_shards(narrow, N_SHARDS, stable=True)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
