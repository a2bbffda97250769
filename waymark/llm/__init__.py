"""Training-data operators: ten corpus-preparation steps over Spark DataFrames.

Nothing else in the library imports this subpackage; ``queries.py`` holds the registered queries and their SQL.
"""
