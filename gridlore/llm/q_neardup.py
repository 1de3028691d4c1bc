"""op4: near-duplicate components of all documents, three-word shingles at 85 percent."""

from gridlore.llm.common import table
from gridlore.llm.neardup import near_duplicates

NAME = "op4_near_duplicates"
ORACLE_SQL = None  # a whole-table self-join is quadratic in SQL; tests compare with brute force


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
