"""Operators for training-data pipelines over document tables.

Nothing else in the library imports this subpackage; `queries.py` registers
its queries and `oracles.py` holds their SQL.
"""
