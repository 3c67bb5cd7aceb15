"""The queries of this subpackage and their SQL."""

from . import lm, media, minhash, packing, pieces, pivots, quality, sharding, toxicity, warc

MODULES = (minhash, pivots, toxicity, lm, quality, media, pieces, sharding, warc, packing)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
