"""Registered queries and the SQL that must give the same rows."""

from seriesforge.plans import ensembles, grids, long_records, surrogates, synthetic  # noqa: F401  (register their queries)
from seriesforge.plans.spectra import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
