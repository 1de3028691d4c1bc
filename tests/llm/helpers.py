import re
import sys

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, rows):
    """Documents from (doc_id, text, lang, source) rows, with a column whose name clashes with internals."""
    return spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], DOCS)


def table_rows(spark, sf, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
