"""The registered queries and their SQL."""

from heron.plans import admin_queries, log_queries, store_queries, text_queries, vector_queries

QUERIES = vector_queries.QUERIES | text_queries.QUERIES | log_queries.QUERIES | admin_queries.QUERIES | store_queries.QUERIES
SQL = vector_queries.SQL | text_queries.SQL | log_queries.SQL | admin_queries.SQL | store_queries.SQL
