"""The registered queries and their SQL."""

from casequarry.plans import drawings, durable, more, queries, running, search

QUERIES = queries.QUERIES | more.QUERIES | durable.QUERIES | search.QUERIES | drawings.QUERIES | running.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | more.ORACLE_SQL | durable.ORACLE_SQL | search.ORACLE_SQL | drawings.ORACLE_SQL | running.ORACLE_SQL
