"""Operators for preparing training text; nothing else in the package imports this subpackage."""

from . import bm25, decontam, hard_negatives, html_text, langid, lines, pieces, secrets, simhash, toxicity, url_rules, warc, whitening

MODULES = [warc, html_text, simhash, decontam, toxicity, langid, secrets, url_rules, pieces, bm25, lines, whitening, hard_negatives]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
