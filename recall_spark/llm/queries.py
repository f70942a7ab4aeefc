"""All queries of this subpackage and the SQL of those that have a SQL form."""

from __future__ import annotations

from . import bpe, chat, collocations, fingerprints, language, lm, near, packing, quality, rollup, structure, substrings, toxicity

_MODULES = (substrings, toxicity, near, quality, rollup, lm, language, bpe, packing, fingerprints, collocations, chat, structure)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
