"""Inputs with the library's schemas, derived by Spark from the star-schema test tables, the queries
that run on them, and the same queries in SQL."""
