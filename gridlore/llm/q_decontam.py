"""op8: benchmark items found in documents."""

from gridlore.llm.common import table
from gridlore.llm.decontam import contaminated

NAME = "op8_decontaminate"
ORACLE_SQL = None  # ranked retrieval over passages; tests compare with scoring every item


def query(spark, sf_dir):
    """One row for each document and benchmark item found in it; clean documents have none."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
