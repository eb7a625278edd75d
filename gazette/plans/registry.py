"""All core queries and their SQL by name."""

from gazette.plans import domain_queries, more_queries, text_queries, units_queries

QUERIES = {**units_queries.QUERIES, **domain_queries.QUERIES, **text_queries.QUERIES, **more_queries.QUERIES}
SQL = {**units_queries.SQL, **domain_queries.SQL, **text_queries.SQL, **more_queries.SQL}
