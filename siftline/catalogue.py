"""All queries by name, with the SQL that gives the same rows."""

from .plans import ORACLE_SQL, QUERIES, corpus, records, retrieval

__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "records", "retrieval"]
