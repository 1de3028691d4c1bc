"""op3: documents mixed to 150% of their tokens, sources weighing 3, 1, 2 in turn."""

from gridlore.llm.common import cut, n_words, seeded, table
from gridlore.llm.mixing import mix

NAME = "op3_mix_sources"
ORACLE_SQL = None  # an iterative dual and its rounding; tests hold it against a brute-force solution


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # the texts are read once; what the mix needs of them is small
    narrow = cut(docs.select("doc_id", "source", n_words(docs["text"]).alias("words"), seeded(1, docs["text"]).alias("text_hash")))
    mixed = mix(narrow, size_col="words", key=["doc_id", "text_hash"], stable=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
