"""op5: the main text of every page."""

from gridlore.llm.common import table
from gridlore.llm.htmltext import extract

NAME = "op5_extract_main_text"
ORACLE_SQL = None  # a minimum cut over parsed markup; tests hold it against known pages and a brute-force cut


def query(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"), html_col="html", carry=["page_id", "url"])
