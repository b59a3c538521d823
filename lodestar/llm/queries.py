"""All queries of this subpackage with their SQL, for the entry module."""

from . import bpe, exact_dedup, langid, lm, media, minhash, packing, sharding, toxicity, url_filter

MODULES = (url_filter, packing, bpe, langid, sharding, lm, exact_dedup, toxicity, media, minhash)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
