"""op10: masked pseudo-likelihood of every document under a network trained on all of them."""

from gridlore.llm.common import table
from gridlore.llm.lmscore import score

NAME = "op10_score_pseudo_likelihood"
ORACLE_SQL = None  # a trained network; tests check gradients, counts and scores by brute force


def query(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), text_col="text", carry=["doc_id"])
