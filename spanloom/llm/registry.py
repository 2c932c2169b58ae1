"""The queries of this subpackage and the SQL that checks them."""

from . import alignment, decontamination, language_id, licenses, merkle, minhash, packing, pii, ppm, substrings, topk, toxicity, url_filter

MODULES = [url_filter, ppm, topk, licenses, toxicity, packing, decontamination, pii, language_id, minhash, substrings, merkle, alignment]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
