"""Operators of a training-data pipeline over document and embedding tables.

One module per operator; ``queries.py`` holds the registered queries. Nothing
else in the library imports this package.
"""
