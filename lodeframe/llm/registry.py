"""The queries of this folder and their SQL."""

from . import jaccard, mixing, packing, quality, secrets, sharding, suffixes, suffixtree, topk, toxicity

MODULES = (secrets, quality, mixing, suffixtree, jaccard, sharding, suffixes, topk, packing, toxicity)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
