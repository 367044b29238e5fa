"""All named queries of the library and their SQL twins."""

from millrace.plans import extras, grouping, joining, predicates, ranking, streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (predicates, grouping, ranking, joining, streams, extras):
    QUERIES.update(_module.R.queries)
    ORACLE_SQL.update(_module.R.sql)
