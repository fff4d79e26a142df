"""Operators for preparing large training corpora and their vector, table and text companions.

Nothing outside this package imports it. ``queries.py`` lists the queries, ``oracles.py`` their SQL.
"""
