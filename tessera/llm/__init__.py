"""Operators for training-data pipelines over a ``documents`` table.

Each module holds one operator with a general interface and the thin ``opN_<name>`` query on it;
``registry`` gathers the queries and their SQL.
"""
