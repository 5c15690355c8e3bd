"""Every query by name, with the SQL that gives the same rows."""

from ferrule.plans import assembly_queries, collector_queries, dossiers, driver_queries, graph_queries, signal_queries, source_queries, store_queries, table_queries, text_queries  # noqa: F401  they register themselves
from ferrule.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
