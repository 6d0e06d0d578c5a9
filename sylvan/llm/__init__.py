"""Training-data operators: deduplication, similarity joins, archives, scoring, packing, encoding.

Nothing else in the library imports this subpackage.  ``entries`` lists the queries and their SQL.
"""
