"""The queries of this package and their SQL."""

from __future__ import annotations

from . import bytecnn, crosstokens, decontaminate, langid, ngram_join, packing, pii, reshard, rules, tokencount, tokenfile, turnrepair, warc

MODULES = (rules, packing, tokenfile, langid, decontaminate, pii, ngram_join, reshard, warc, bytecnn,
           tokencount, crosstokens, turnrepair)
QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.SQL.items()}
