"""All queries and their SQL by name."""

from . import q_index, q_io, q_spatial, q_stats, q_windows

MODULES = [q_windows, q_index, q_spatial, q_stats, q_io]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
