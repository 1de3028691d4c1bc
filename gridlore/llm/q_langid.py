"""op2: the language of every document; a fifth of them is held out of training."""

from pyspark.sql import functions as F

from gridlore.llm.common import table
from gridlore.llm.langid import fit, identify

NAME = "op2_identify_language"
ORACLE_SQL = None  # a trained model; tests measure held-out accuracy


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))  # a null id never trains
    model = fit(docs.where(~out), text_col="text", lang_col="lang", id_col="doc_id")
    return identify(docs.withColumn("held_out", out), model, text_col="text", carry=["doc_id", "held_out"])
