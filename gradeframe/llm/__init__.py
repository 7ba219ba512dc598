"""Operators of a training-data pipeline on Spark; see ``queries.py`` for their registered queries."""
