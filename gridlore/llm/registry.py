"""The queries of the training-data operators: ``opN_<name>`` over whole tables."""

from __future__ import annotations

from gridlore.llm import q_chat, q_decontam, q_htmltext, q_langid, q_lmscore, q_mixing, q_neardup, q_quality, q_sharding, q_urlfilter

MODULES = [q_sharding, q_langid, q_mixing, q_neardup, q_htmltext, q_quality, q_chat, q_decontam, q_urlfilter, q_lmscore]


def queries():
    return {m.NAME: m.query for m in MODULES}


def oracle_sql():
    return {m.NAME: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL}
