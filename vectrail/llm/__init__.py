"""Training-data operators: filtering, deduplication, mixing and token output.

Each module holds one operator; ``entries`` holds the registered queries and
their SQL.  Nothing outside this package imports it.
"""
