"""op6: base statistics and the learned verdict of every document."""

from gridlore.llm.common import table
from gridlore.llm.quality import judge

NAME = "op6_quality_rules"
ORACLE_SQL = None  # the verdict is learned; tests hold the statistics against brute force


def query(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
