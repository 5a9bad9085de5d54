"""All oracle SQL by query name."""

from checks import consensus_sql, records_sql, scoring_sql

ORACLES = {**scoring_sql.QUERIES, **consensus_sql.QUERIES, **records_sql.QUERIES}
