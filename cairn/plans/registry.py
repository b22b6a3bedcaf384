"""All registered queries on the library's own operators, and the SQL that checks them."""

from cairn.plans import catalog_queries, search_queries, store_queries, view_queries

QUERIES = {**search_queries.QUERIES, **catalog_queries.QUERIES, **view_queries.QUERIES, **store_queries.QUERIES}
SQL = {**search_queries.SQL, **catalog_queries.SQL, **view_queries.SQL, **store_queries.SQL}
