"""The queries and SQL of all corpus operators."""

from spindrift.llm import decontaminate, divergence, hard_negatives, html_text, language, order_minhash, packing, quality, simhash, token_counts, token_orc, toxicity, warc

_MODULES = (warc, packing, token_orc, simhash, order_minhash, language, quality, toxicity, html_text, decontaminate, hard_negatives, token_counts, divergence)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
