"""Relational operators: aggregations, runs, lookups, evaluation, the staged front end."""
