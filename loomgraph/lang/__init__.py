"""Tokens, syntax tree and parser of the query language; no Spark in here."""
