"""Queries over the test tables, each with its SQL."""

from barloom.plans import bar_queries, model_queries, policy_queries, prediction_queries, review_queries

QUERIES = {**bar_queries.QUERIES, **prediction_queries.QUERIES, **review_queries.QUERIES, **policy_queries.QUERIES, **model_queries.QUERIES}
SQL = {**bar_queries.SQL, **prediction_queries.SQL, **review_queries.SQL, **policy_queries.SQL, **model_queries.SQL}
