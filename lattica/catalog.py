"""All queries of the graph engine and their SQL, by name."""

from __future__ import annotations

from lattica.queries import core, curation, extra, more, stereo, structures

QUERIES: dict = core.QUERIES | more.QUERIES | curation.QUERIES | extra.QUERIES | stereo.QUERIES | structures.QUERIES
ORACLE_SQL: dict = core.ORACLE_SQL | more.ORACLE_SQL | curation.ORACLE_SQL | extra.ORACLE_SQL | stereo.ORACLE_SQL | structures.ORACLE_SQL
